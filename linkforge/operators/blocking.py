"""Inverted-index retrieval: keys, capped document frequency, weights, scores, three rankings.

``retrieve`` and ``pair_scores`` sum and rank the pairs of a block of queries within one task, so that
no pair is shuffled: what moves is each key once, as a 64-bit hash (as in the reference), and then the
lists of targets that a block's keys meet. ``scores`` and ``ranked`` are the same as joins, for small
batches of arrivals against a kept index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions.keys import ADDR_TOKENS, NAME_TOKENS, addr_tokens, name_tokens, record_keys

FAMILIES = ("name", "addr", "cross")
#: Queries of a key, or of a country, beyond which they are dealt to several tasks, and the share of all postings that a key must hold: one of so many.
HOT, SHARE = 20_000, 10_000
#: Rows of a batch that a block gives back.
BATCH = 50_000


def postings(records: DataFrame, name: int | None = NAME_TOKENS, addr: int | None = ADDR_TOKENS) -> DataFrame:
    """(id, src, country, fam, key) of records with core, addr and state, by their first ``name`` and ``addr`` tokens (None: all). One pass, no shuffle."""
    tokens = records.select("id", "src", "country", name_tokens(F.col("core"), name).alias("nt"), addr_tokens(F.col("addr"), F.col("state"), addr).alias("at"))
    keys = record_keys(F.col("nt"), F.col("at"))
    families = F.array(*[F.struct(F.lit(f).alias("fam"), keys[f].alias("keys")) for f in FAMILIES])
    return tokens.select("id", "src", "country", F.explode(families).alias("f")).select("id", "src", "country", "f.fam", F.explode("f.keys").alias("key"))


def key_stats(targets: DataFrame, records: DataFrame, cap: int) -> DataFrame:
    """(country, src, fam, key, df, idf) of keys in at most ``cap`` targets: log1p(targets of the partition / df).

    The cap bounds the targets of a key; its queries may be many (see ``scores``).
    """
    df = targets.groupBy("country", "src", "fam", "key").agg(F.count("*").alias("df")).where(F.col("df") <= cap)
    n = records.groupBy("country", "src").agg(F.count("*").alias("n"))  # a row for each country and source
    return df.join(n, ["country", "src"]).withColumn("idf", F.log1p(F.col("n") / F.col("df"))).drop("n")


def scores(queries: DataFrame, targets: DataFrame, stats: DataFrame) -> DataFrame:
    """(country, src, s1, t, s_name, s_addr, s_cross): summed weights of shared keys by family.

    A key that many queries hold is dealt to several tasks by the hash of the query; its targets, at
    most the cap of the statistics, go to each of them.
    """
    on = ["country", "src", "fam", "key"]
    weighted = targets.join(stats.select(*on, "idf"), on).select(*on, F.col("id").alias("t"), "idf")
    asked = queries.select("country", "fam", "key", F.col("id").alias("s1"))
    own = ["country", "fam", "key"]
    held = asked.groupBy(*own).agg(F.count("*").alias("held"))
    least = F.greatest(F.lit(HOT), F.col("all") / SHARE)  # at most ``SHARE`` keys can hold more
    hot = held.join(held.agg(F.sum("held").alias("all"))).where(F.col("held") > least).select(*own, F.ceil(F.col("held") / least).cast("int").alias("salts"))  # one row of sums
    salted = asked.join(F.broadcast(hot), own, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("s1"), "salts").cast("int"), F.lit(0))).drop("salts")
    weighted = weighted.join(F.broadcast(hot), own, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    met = salted.join(weighted, [*own, "salt"])
    sums = [F.round(F.sum(F.when(F.col("fam") == f, F.col("idf")).otherwise(0.0)), 6).alias(f"s_{f}") for f in FAMILIES]
    return met.groupBy("country", "src", "s1", "t").agg(*sums)


def _quantised(score: Column, by: int, most: int) -> Column:
    return F.least(F.greatest(F.bround(score * by, 0), F.lit(0)), F.lit(most))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds s_tot, rank, rank_name, rank_addr: by quantised score, then total, then target."""
    out = scored.withColumn("s_tot", F.round(F.col("s_name") + F.col("s_addr") + F.col("s_cross"), 6))
    own = Window.partitionBy("country", "src", "s1")
    for name, by in (("rank", "s_tot"), ("rank_name", "s_name"), ("rank_addr", "s_addr")):
        order = own.orderBy(_quantised(F.col(by), 64, 2**20 - 1).desc(), _quantised(F.col("s_tot"), 16, 4095).desc(), "t")
        out = out.withColumn(name, F.least(F.row_number().over(order) - 1, F.lit(32767)).cast("int"))
    return out


def cut(pool: DataFrame, k_total: int, k_name: int, k_addr: int) -> DataFrame:
    """The union of three rankings; each needs its score above zero."""
    return pool.where(
        ((F.col("rank") < k_total) & (F.col("s_tot") > 0)) | ((F.col("rank_name") < k_name) & (F.col("s_name") > 0)) | ((F.col("rank_addr") < k_addr) & (F.col("s_addr") > 0))
    )


def _cells(records: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """What each block of queries needs of each source, and the countries by their numbers.

    (land, src, block, fam, idf, ts, qs, id): a row for each key that both sides hold and at most ``cap``
    targets, with hashes of the ids of its targets and of its queries in the block; and, fam null, a row
    for each target of the source, its hash in ts, and for each query of the block, its hash in qs.
    """
    records = records.where("country is not null")
    sizes = records.groupBy("country", "src").agg(F.count("*").alias("n"))
    asks = F.sum(F.when(F.col("src") == 1, F.col("n")).otherwise(0))
    lands = sizes.groupBy("country").agg(F.ceil(asks / HOT).cast("int").alias("blocks")).withColumn("land", F.row_number().over(Window.orderBy("country")))  # a row for each country
    sizes = F.broadcast(sizes.join(lands, "country").where("src <> 1 and blocks > 0").select("land", "src", "n", "blocks"))
    known, who = F.broadcast(lands.where("blocks > 0")), F.xxhash64("id")
    block = F.pmod(F.col("who"), F.col("blocks").cast("long")).cast("int")

    def held(side: str) -> DataFrame:
        """(h, place, own): hashes of the ids that hold a key; h ends with its family, place is the country's number and the block or source."""
        keys = postings(records.where(side)).join(known, "country")
        fam = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FAMILIES) for x in (f, k)]), F.col("fam")).cast("long")
        h = F.xxhash64("country", "fam", "key").bitwiseAND(F.lit(~3)).bitwiseOR(fam)
        of = block if side == "src = 1" else F.col("src")
        keys = keys.select(h.alias("h"), "land", who.alias("who"), "blocks", "src").select("h", F.shiftleft(F.col("land").cast("long"), 32).bitwiseOR(of.cast("long")).alias("place"), "who")
        return keys.repartition("h").groupBy("h", "place").agg(F.collect_list("who").alias("own"))

    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    targets = held("src <> 1").where(F.size("own") <= cap).select("h", low("place").alias("src"), F.col("own").alias("ts"))
    queries = held("src = 1").select("h", F.shiftright("place", 32).cast("int").alias("land"), low("place").alias("block"), F.col("own").alias("qs"))
    met = targets.join(queries, "h").join(sizes.drop("blocks"), ["land", "src"])
    met = met.select("land", "src", "block", F.col("h").bitwiseAND(F.lit(3)).cast("int").alias("fam"), F.log1p(F.col("n") / F.size("ts")).alias("idf"), "ts", "qs", F.lit(None).cast("string").alias("id"))
    ids = records.join(known, "country").select("land", "src", "blocks", "id", who.alias("who")).distinct()
    none, own = F.lit(None).cast("array<bigint>"), F.array("who")
    blank = [F.lit(None).cast("int").alias("fam"), F.lit(None).cast("double").alias("idf")]
    of_targets = ids.where("src <> 1").select("land", "src", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *blank, own.alias("ts"), none.alias("qs"), "id")
    of_queries = ids.where("src = 1").withColumn("block", block).drop("src", "blocks").join(sizes.select("land", "src"), "land").select("land", "src", "block", *blank, none.alias("ts"), own.alias("qs"), "id")
    return met.unionByName(of_targets).unionByName(of_queries), F.broadcast(lands.select("land", "country"))


class _Side:
    """The ids of one side of a cell, in order, and the numbers of their hashes."""

    def __init__(self, ids: list[pa.Array], hashes: list[np.ndarray]):
        ids, hashes = pa.concat_arrays(ids) if ids else pa.array([], pa.string()), np.concatenate([*hashes, np.empty(0, np.int64)])
        order = pc.sort_indices(ids).to_numpy()
        self.ids, by_id = ids.take(pa.array(order)), hashes[order]
        self.place = np.argsort(by_id).astype(np.int32)
        self.hashes = by_id[self.place]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two ids share a 64-bit hash")

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.hashes, hashes)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple:
    """Both sides, and of the keys, ordered by family: family, weight, ends of the lists, numbers of targets and of queries."""
    ids, hashes, keys = {"ts": [], "qs": []}, {"ts": [], "qs": []}, []
    for batch in batches:
        fam = batch.column("fam")
        for side in ids:
            one = batch.filter(pc.and_(pc.is_null(fam), pc.is_valid(batch.column(side))))
            ids[side].append(one.column("id").cast(pa.string()))
            hashes[side].append(one.column(side).flatten().to_numpy(zero_copy_only=False))
        met = batch.filter(pc.is_valid(fam))
        lists = [(pc.list_value_length(met.column(c)).to_numpy(zero_copy_only=False), met.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("ts", "qs")]
        keys.append((met.column("fam").to_numpy(zero_copy_only=False), met.column("idf").to_numpy(zero_copy_only=False), *lists))
    targets, queries = (_Side(ids[c], hashes[c]) for c in ("ts", "qs"))
    empty = np.empty(0, np.int64)
    join = lambda of: np.concatenate([*map(of, keys), empty])
    fam, idf = join(lambda k: k[0]).astype(np.int8), np.concatenate([*(k[1] for k in keys), np.empty(0)])
    n_t, n_q = join(lambda k: k[2][0]), join(lambda k: k[3][0])
    ts = np.concatenate([*(targets.numbers(k[2][1]) for k in keys), empty.astype(np.int32)])
    qs = np.concatenate([*(queries.numbers(k[3][1]) for k in keys), empty.astype(np.int32)])
    return targets, queries, fam, idf, n_t, ts, n_q, qs


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each query of a cell that meets any: both sides, its number, the numbers of its targets in order and their rounded sums by family."""
    targets, queries, fam, idf, n_t, ts, n_q, qs = _gathered(batches)
    rows = np.repeat(np.arange(len(fam), dtype=np.int32), n_q)
    order = np.lexsort((fam[rows], qs))
    rows, ends = rows[order], np.searchsorted(qs[order], np.arange(len(queries.ids) + 1))
    start = np.cumsum(n_t) - n_t
    seen, local = np.zeros(len(targets.ids), bool), np.empty(len(targets.ids), np.int32)
    for q in range(len(queries.ids)):
        own = rows[ends[q] : ends[q + 1]]
        if not len(own):
            continue
        many = n_t[own]
        upto = np.cumsum(many)
        t = ts[np.repeat(start[own] - upto + many, many) + np.arange(upto[-1])]
        weight = np.repeat(idf[own], many)
        seen[t] = True
        found = np.flatnonzero(seen)
        local[found] = np.arange(len(found), dtype=np.int32)
        seen[found] = False
        at = local[t]
        cuts = [0, *(int(upto[k - 1]) if k else 0 for k in np.searchsorted(fam[own], (1, 2))), int(upto[-1])]
        yield targets, queries, q, found, [_rounded(np.bincount(at[a:b], weight[a:b], len(found))) for a, b in zip(cuts, cuts[1:], strict=False)]


def _batches(parts: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parts (both sides, the query's number, targets' numbers, further columns) as batches of some size."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        targets, queries = held[0][0], held[0][1]
        s1 = np.repeat([x[2] for x in held], [len(x[3]) for x in held])
        columns = [queries.ids.take(pa.array(s1)), targets.ids.take(pa.array(np.concatenate([x[3] for x in held])))]
        columns += [pa.array(np.concatenate(c)) for c in zip(*(x[4] for x in held), strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*first(len(s1)), *columns], schema, strict=True)], schema=schema)

    first = lambda n: (pa.repeat(pa.scalar(x, pa.int32()), n) for x in place)
    place = next(parts)  # the cell's land and source
    for part in parts:
        held.append(part)
        rows += len(part[3])
        if rows >= BATCH:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


SUMS = "land int, src int, s1 string, t string, s_name double, s_addr double, s_cross double, s_tot double"
_SUMS = pa.schema([("land", pa.int32()), ("src", pa.int32()), ("s1", pa.string()), ("t", pa.string()), *((f"s_{f}", pa.float64()) for f in (*FAMILIES, "tot"))])
RANKS = ("rank", "rank_name", "rank_addr")


def pair_scores(records: DataFrame, cap: int = 3000) -> DataFrame:
    """All pairs that share a key of at most ``cap`` targets: (country, src, s1, t, s_name, s_addr, s_cross, s_tot)."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            yield key[0].as_py(), key[1].as_py()
            for targets, queries, q, found, sums in _matches(batches):
                yield targets, queries, q, found, [*sums, _rounded(sum(sums))]

        return _batches(parts(), _SUMS)

    cells, lands = _cells(records, cap)
    return cells.groupBy("land", "src", "block").applyInArrow(run, SUMS).join(lands, "land").select("country", "src", "s1", "t", *[f"s_{f}" for f in FAMILIES], "s_tot")


def retrieve(records: DataFrame, cap: int = 3000, k_total: int = 30, k_name: int = 15, k_addr: int = 15) -> DataFrame:
    """Candidates of the records of source 1 among those of the others, country by country: ``cut`` of what ``ranked`` says of all pairs."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            yield key[0].as_py(), key[1].as_py()
            for targets, queries, q, found, sums in _matches(batches):
                total = _rounded(sum(sums))
                second = np.minimum(np.rint(total * 16), 4095).astype(np.int64) << 31
                last = len(targets.ids) - 1 - found
                values = [(np.minimum(np.rint(v * 64), 2**20 - 1).astype(np.int64) << 43) + second + last for v in (total, sums[0], sums[1])]
                orders = [np.sort(v) for v in values]
                kept = np.zeros(len(found), bool)
                for v, order, score, k in zip(values, orders, (total, sums[0], sums[1]), (k_total, k_name, k_addr), strict=True):
                    if k > 0:
                        kept |= (v >= order[-min(k, len(order))]) & (score > 0)
                at = np.flatnonzero(kept)
                ranks = [np.minimum(len(order) - 1 - np.searchsorted(order, v[at]), 32767) for v, order in zip(values, orders, strict=True)]
                if len(at):
                    yield targets, queries, q, found[at], [*(s[at] for s in sums), total[at], *ranks]

        return _batches(parts(), pa.schema([*_SUMS, *(pa.field(r, pa.int32()) for r in RANKS)]))

    cells, lands = _cells(records, cap)
    out = cells.groupBy("land", "src", "block").applyInArrow(run, f"{SUMS}, {', '.join(f'{r} int' for r in RANKS)}").join(lands, "land")
    return out.select("country", "src", "s1", "t", *[f"s_{f}" for f in FAMILIES], "s_tot", *RANKS)
