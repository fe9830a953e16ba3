"""N-gram Jaccard join: classes of documents whose shingle sets link, without expanding pairs.

The document by n-gram incidence is multiplied in blocks. Its columns are dealt into so many blocks
that two documents over the threshold agree in one of them wholly (``shingles.Blocks``): pairs that
agree in none are below the bound that their sizes set and get no cell of the product. Equal sets
are one row of the matrix. What is left is found in three steps, none of which makes a row for each
pair of a group:

1. Stars. In each block the row that meets most rows in all its blocks is the centre, and each row is
   multiplied with one centre of its blocks. That joins most of a group into a part.
2. Bounds. The rows of each block that still has more than one part go to a worker once, with a
   parity sketch that bounds the overlap from above; of blocks that hold the same rows one stands for
   all. Of the pairs that may reach their bound the worker hands on a spanning forest; its components
   are the clusters.
3. Tiles. The sets of a cluster meet in a worker, where overlap counts are accumulated over blocks of
   columns and pairs that can no longer reach their bound are left out.

Blocks and clusters too large for one worker are dealt into tiles; two tiles of one part do not meet.
Step 1 only spares work: steps 2 and 3 settle all that is still open.

Defined results: a null, empty or blank text has an empty set and links with nothing; a null doc_id
links with nothing and has a null component; each repeated row gets its row; rows that repeat a doc_id
with another text are nodes of their own, named by the least doc_id that they reach; a very long text
counts for several rows of a tile; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import cut, join_small, pieces, text_or_empty
from linkforge.llm.graphs import components
from linkforge.llm.shingles import Blocks, mix, parities, shingle_set

#: Rows of a tile of bounds and of a tile of sets, shingles that count as one such row, rows that may be broadcast.
BOUND_TILE, TILE, ROW, SMALL = 512, 400, 2_500, 300_000


def _signed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, mark, n, f1, f2, sketch, keys, budgets): set size, 128-bit fingerprint of the set, parities, block signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(num, den)
        for batch in pieces(batches):
            sizes, prints, sketches, keys, budgets = [], [[], []], [], [], []
            for known, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                for k in (0, 1):
                    prints[k].append(np.int64(mix(s, 4 + k).sum().astype(np.int64)) if len(s) else 0)
                sketches.append(parities(s) if len(s) else b"")
                own, budget = blocks.signatures(s)
                keys.append(own.view(np.int64) if known else np.empty(0, np.int64))
                budgets.append(budget)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), pa.array(sketches, pa.binary()), listed, pa.array(budgets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n", "f1", "f2", "sketch", "keys", "budgets"])

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n long, f1 long, f2 long, sketch binary, keys array<long>, budgets array<int>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, grams): sorted 64-bit hashes of the shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "grams"])

    return docs.select("id", "text").mapInArrow(run, "id long, grams binary")


def linked(overlap, a, b, num: int, den: int):
    return den * overlap >= num * (a + b - overlap)


class Forest:
    """Edges that join different trees."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        if (x := self.find(a)) != (y := self.find(b)):
            self.parent[x] = y
            self.edges.append((a, b))


def tile_links(sets: list[np.ndarray], groups: np.ndarray, num: int, den: int, columns: int = 2048) -> list[tuple[int, int]]:
    """Pairs of rows of different groups that link, as a spanning forest.

    Overlap counts are accumulated over blocks of columns; between them, rows without a pair that can
    still reach its bound are left out.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    grams, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(shared.sum())
    small, big = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    need = -(-num * (small + big) // (num + den))
    alive = (groups[:, None] != groups[None, :]) & (small >= need) & np.triu(np.ones(small.shape, bool), 1)
    left = np.bincount(row, minlength=len(sets))
    overlap = np.zeros(small.shape, np.int64)
    for c in range(0, total, columns):
        alive &= overlap + np.minimum.outer(left, left) >= need
        rows = np.flatnonzero(alive.any(0) | alive.any(1))
        if not len(rows):
            return []
        i, j = np.searchsorted(column, (c, c + columns))
        left = left - np.bincount(row[i:j], minlength=len(sets))
        tile = np.zeros((len(sets), columns), np.float32)
        tile[row[i:j], column[i:j] - c] = 1
        tile = tile[rows]
        overlap[np.ix_(rows, rows)] += (tile @ tile.T).astype(np.int64)
    alive &= overlap >= need
    forest = Forest(len(sets))
    for a, b in zip(*map(np.ndarray.tolist, np.nonzero(alive)), strict=True):
        forest.join(a, b)
    return forest.edges


def _sets_of(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, grams) of the documents of ``ids`` (id)."""
    wanted = cut(ids.distinct())
    return cut(_sets(join_small(rows, wanted, ["id"], "left_semi", wanted.count(), SMALL), width))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that link, by their overlap counts; ``pairs`` has a row for each u."""

    def overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                keep.append(linked(int((both[1:] == both[:-1]).sum()), len(x), len(y), num, den))
            yield pdf.loc[np.array(keep, bool), ["u", "v"]]

    n = pairs.count()
    left = join_small(sets.select(F.col("id").alias("u"), F.col("grams").alias("a")), pairs, ["u"], "inner", n, SMALL)
    centres = pairs.select("v").distinct()
    right = join_small(sets.select(F.col("id").alias("v"), F.col("grams").alias("b")), centres, ["v"], "left_semi", n, SMALL)
    return cut(left.join(right, "v").select("u", "v", "a", "b").mapInPandas(overlaps, "u long, v long"))


def _dealt(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` (group, cls, part, n, ...) with (ta, tb): any two rows of a group that are in different parts share one (ta, tb).

    Groups of at most ``tile`` rows stay whole. Larger ones are cut into tiles, a part of more than
    ``tile`` rows into tiles of its own, which meet all tiles but their like.
    """
    weight = F.greatest(F.lit(1.0), F.col("n") / F.lit(ROW))
    sizes = rows.groupBy("group", "part").agg(F.sum(weight).alias("size"))
    loose = F.sum(F.when(F.col("size") <= tile, F.col("size")).otherwise(0.0)).alias("loose")
    wide = cut(sizes.groupBy("group").agg(F.sum("size").alias("whole"), loose, F.sum((F.col("size") > tile).cast("int")).alias("large")).where(F.col("whole") > tile))
    many = wide.count()
    whole = join_small(rows, wide.select("group"), ["group"], "left_anti", many, SMALL).withColumns({"ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long")})
    if not many:
        return whole
    large = cut(sizes.where(F.col("size") > tile).select("group", "part", F.ceil(F.col("size") / tile).alias("tiles")))
    cut_up = join_small(rows, wide.drop("whole"), ["group"], "inner", many, SMALL)
    cut_up = join_small(cut_up, large, ["group", "part"], "left", large.count(), SMALL)
    of_part = F.xxhash64("part", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    mixed = F.xxhash64(F.lit(None).cast("long"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("loose") / tile)))
    cut_up = cut_up.withColumns({"own": F.when(F.col("tiles").isNotNull(), F.col("part")), "tile": F.when(F.col("tiles").isNotNull(), of_part).otherwise(mixed), "alone": F.col("large") < 2}).drop("tiles", "loose", "large")
    tiles = cut(cut_up.select("group", "tile", "own", "alone").distinct())
    side = lambda k, of: tiles.where(of).select("group", F.col("tile").alias(f"t{k}"), F.col("own").alias(f"own_{k}"))
    in_parts = F.col("own").isNotNull()
    grid = side("a", ~in_parts).join(side("b", ~in_parts), "group").where("ta <= tb")
    grid = grid.unionByName(side("a", ~in_parts).join(side("b", in_parts), "group"))
    grid = grid.unionByName(side("a", in_parts & ~F.col("alone")).join(side("b", in_parts & ~F.col("alone")), "group").where("own_a < own_b"))
    grid = cut(grid.select("group", "ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile")))
    met = join_small(cut_up.drop("own", "alone"), grid, ["group", "tile"], "inner", grid.count(), SMALL).drop("tile")
    return whole.unionByName(met)


def _by_group(rows: DataFrame, payload: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray, list], list[tuple[int, int]]]) -> DataFrame:
    """(u, v) that ``work`` finds among the rows (cls, part, n, payload) of each (group, ta, tb)."""
    by = ["group", "ta", "tb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            cls, part, n = (batch.column(k).to_numpy() for k in (3, 4, 5))
            out = []
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                if j - i > 1:
                    out += work(cls[i:j], part[i:j], n[i:j], [x.as_py() for x in batch.column(6).slice(i, j - i)])
            u, v = zip(*out, strict=True) if out else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            rest = batch.slice(starts[-1])  # its group may go on in the next batch
            yield found(batch, starts[:-1], starts[1:])
        if rest is not None:
            yield found(rest, np.array([0]), np.array([len(rest)]))

    dealt = rows.select(*by, "cls", "part", "n", payload).repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "u long, v long")


def bounded_pairs(cls: np.ndarray, part: np.ndarray, n: np.ndarray, sketches: list[bytes], blocks: Blocks) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows of different parts that may link by their sizes and sketches."""
    width = min(map(len, sketches))
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0) for s in sketches]).view(np.uint64)
    forest = Forest(len(cls))
    for i in range(len(cls) - 1):
        j = np.flatnonzero((part[i + 1 :] != part[i]) & blocks.sizes_fit(n[i], n[i + 1 :])) + i + 1
        if len(j):
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
            for k in j[differ <= blocks.differ(n[i], n[j])].tolist():
                forest.join(i, k)
    return [(int(cls[a]), int(cls[b])) for a, b in forest.edges]


def _blocks(kept: DataFrame) -> DataFrame:
    """(key, cls, centre) of the blocks of more than one row, one block for all that hold the same rows; ``kept``: (key, cls, degree)."""
    order = F.struct("degree", F.xxhash64("cls", F.lit(1)).alias("h"), "cls")
    rows = [F.sum(F.xxhash64("cls", F.lit(seed)).cast("decimal(38,0)")).alias(f"rows{seed}") for seed in (2, 3)]
    by_key = kept.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.max(order).alias("centre"), *rows).where("low < high")
    return kept.drop("degree").join(by_key.groupBy("low", "high", "rows2", "rows3").agg(F.min_by(F.struct("key", "centre"), "key").alias("b")).select("b.*"), "key")


def _parts(links: DataFrame) -> DataFrame:
    """(cls, part): ``links`` (u, v), one for each u and never in a ring, followed for up to four steps."""
    up = links
    for _ in range(2):
        up = up.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    return cut(up.select(F.col("u").alias("cls"), F.col("v").alias("part")))


def _links(kept: DataFrame, rows: DataFrame, signed: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """(node, component) of the rows that link with another; ``kept``: (key, cls, degree)."""
    cells = cut(_blocks(kept))
    if cells.isEmpty():
        return None
    sets = _sets_of(rows, cells.select(F.col("cls").alias("id")), width)
    stars = cells.where("cls <> centre.cls").groupBy(F.col("cls").alias("u")).agg(F.max("centre").alias("c")).select("u", F.col("c.cls").alias("v"))
    links = verified(cut(stars), sets, num, den)
    parts = _parts(links)
    parted = lambda df: join_small(df, parts, ["cls"], "left", parts.count(), SMALL).withColumn("part", F.coalesce("part", "cls"))
    placed = parted(cells.select("key", "cls"))
    more = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    still = placed.join(more, "key").withColumnRenamed("key", "group")
    blocks = Blocks(num, den)
    sketched = still.join(signed.select(F.col("id").alias("cls"), "n", "sketch"), "cls")
    near = _by_group(_dealt(cut(sketched), BOUND_TILE), "sketch", lambda cls, part, n, sketches: bounded_pairs(cls, part, n, sketches, blocks))
    clusters = components(near)
    grouped = cut(parted(clusters.select(F.col("component").alias("group"), F.col("node").alias("cls"))))
    filled = join_small(sets.withColumnRenamed("id", "cls"), grouped, ["cls"], "inner", grouped.count(), SMALL).withColumn("n", F.floor(F.length("grams") / 8))

    def tile(cls: np.ndarray, part: np.ndarray, _n: np.ndarray, grams: list[bytes]) -> list[tuple[int, int]]:
        return [(int(cls[a]), int(cls[b])) for a, b in tile_links([np.frombuffer(g, np.uint64) for g in grams], part, num, den)]

    return cut(components(links.union(_by_group(_dealt(filled, TILE), "grams", tile))))


def _renumbered(rows: DataFrame, signed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``ngram_rows`` where a doc_id has several sets: the rows get numbers of their own."""
    known = cut(rows.where("id is not null").withColumn("row", F.monotonically_increasing_id()))
    found = ngram_rows(known.select("row", "text"), width, num, den, "row").select("row", "n_shingles", F.col("component_id").alias("lead"))
    both = cut(known.select("row", "id", "mark").join(found, "row"))
    first = F.min(F.struct("id", "mark")).alias("first")
    named = both.join(both.where("lead is not null").groupBy("lead").agg(first), "lead", "left")
    out = named.select("id", "mark", "n_shingles", F.col("first.id").alias("component_id"), (F.struct("id", "mark") == F.col("first")).alias("leads"))
    return out.unionByName(signed.where("id is null").select("id", "mark", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("leads")))


def ngram_rows(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_shingles, component_id, leads) of every row: links of sets of ``width`` words at Jaccard ``num / den`` or more.

    ``mark`` is xxhash64 of the text; ``leads``: whether the row has the least (id, mark) of its component.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    signed = cut(_signed(rows, width, num, den))
    whole = F.struct("f1", "f2", "n")
    by_id = signed.where("id is not null").groupBy("id").agg(F.min(whole).alias("a"), F.max(whole).alias("b"), F.count("*").alias("n"))
    several, repeated = by_id.agg(F.max(F.expr("a <> b")), F.max("n")).first()
    if several:
        return _renumbered(rows, signed, width, num, den).withColumnRenamed("id", id_col)
    each = lambda df: df.dropDuplicates(["id"]) if (repeated or 0) > 1 else df
    classes = cut(signed.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "mark")).alias("first")).withColumn("cls", F.col("first.id")))
    own = join_small(each(signed.select("id", "keys")), classes.select(F.col("cls").alias("id")), ["id"], "left_semi", classes.count(), SMALL)
    blocks = own.select(F.explode("keys").alias("key"), F.col("id").alias("cls"))
    met = cut(blocks.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"))
    cells = cut(blocks.join(met, "key"))
    # Each row leaves out as many of the blocks that most rows hold as its budget allows.
    budgets = signed.where("size(budgets) > 0").select(F.col("id").alias("cls"), F.explode("budgets").alias("b")).groupBy("cls", (F.col("b") % 64).alias("tag")).agg(F.min(F.floor(F.col("b") / 64)).alias("budget"))
    tagged = cells.withColumn("tag", F.col("key").bitwiseAND(Blocks.TAG).cast("int")).join(budgets, ["cls", "tag"], "left")
    nth = F.row_number().over(Window.partitionBy("cls", "tag").orderBy(F.desc("held"), "key"))
    degree = F.sum("held").over(Window.partitionBy("cls"))
    kept = tagged.withColumn("degree", degree).withColumn("nth", nth).where("nth > coalesce(budget, 0)").select("key", "cls", "degree")
    final = _links(cut(kept), each(rows), each(signed.select("id", "n", "sketch")), width, num, den)
    named = classes.withColumn("component", F.col("cls"))
    if final is not None:  # a component's node is its least doc_id
        named = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        named = named.join(classes.select(F.col("cls").alias("component"), F.col("first").alias("lead")), "component")
    else:
        named = named.withColumn("lead", F.col("first"))
    both = signed.select("id", "mark", "n", "f1", "f2").join(named.select("f1", "f2", "n", "component", "lead"), ["f1", "f2", "n"], "left")
    alone = F.col("component").isNull() | F.col("id").isNull()
    return both.select(
        F.col("id").alias(id_col),
        "mark",
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        (alone | F.coalesce(F.struct("id", "mark") == F.col("lead"), F.lit(False))).alias("leads"),
    )


def ngram_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    return ngram_rows(docs, width, num, den, id_col, text_col).select(id_col, "n_shingles", "component_id")
