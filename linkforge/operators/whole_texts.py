"""Scores of all pairs by the keys of whole texts, where every token and every pair of tokens is a key.

Keys of pairs grow with the square of a text's tokens, so none is written or moved: what moves is each
record's tokens once (for targets, once for each block of queries), as 64-bit hashes. A task holds the
targets of a country and source and the queries of a block, counts the targets of the pairs of tokens
that a query holds, and sums their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions.keys import addr_tokens, name_tokens
from linkforge.operators import blocking

#: A token that more than one of so many targets hold is common, up to so many tokens: pairs of common tokens are summed by matrices, others one by one. None is left out.
SHARE, COMMON = 64, 2048
#: Blocks that a country's queries are dealt to where none gets fewer than so many, and partitions of the cells, as their rows are few for the work.
BLOCKS, LEAST, PARTS = 3, 500, 200
#: Pairs of tokens, and targets, taken at once.
PAIRS, SLICE = 2_000_000, 4096
NAME, ADDR, WHOLE = range(3)


def _cells(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(land, src, block, query, id, n, a, c): a row for each query, and for each target and block, and the countries by their numbers.

    n, a and c are hashes of the tokens of the name, of those of the address, and of the joined name if there is any.
    """
    records = records.where("country is not null")
    sizes = records.groupBy("country").agg(F.count(F.when(F.col("src") == 1, 1)).alias("asks"))
    most = F.least(F.lit(blocking.HOT), F.greatest(F.lit(LEAST), F.col("asks") / BLOCKS))
    lands = sizes.select("country", F.ceil(F.col("asks") / most).cast("int").alias("blocks"), F.row_number().over(Window.orderBy("country")).alias("land"))  # a row for each country
    nt, at = name_tokens(F.col("core"), None), addr_tokens(F.col("addr"), F.col("state"), None)
    tokens = records.select("id", "src", "country", nt.alias("nt"), at.alias("at")).join(F.broadcast(lands.where("blocks > 0")), "country")
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    whole = F.when(F.size("nt") > 0, F.array(F.xxhash64(F.array_join("nt", "")))).otherwise(F.array().cast("array<bigint>"))
    columns = ["id", hashed("nt").alias("n"), hashed("at").alias("a"), whole.alias("c")]
    block, every = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    sources = F.broadcast(records.where("src <> 1").select("country", F.col("src").alias("of")).distinct())
    queries = tokens.where("src = 1").join(sources, "country").select("land", F.col("of").alias("src"), block.alias("block"), F.lit(True).alias("query"), *columns)
    targets = tokens.where("src <> 1").select("land", "src", F.explode(every).alias("block"), F.lit(False).alias("query"), *columns)
    return queries.unionByName(targets), F.broadcast(lands.select("land", "country"))


class _Rows:
    """The records of one side: their ids in order, the number of each record's id, and by kind the records' numbers of tokens and the tokens."""

    def __init__(self, batches: list[pa.RecordBatch]):
        ids = pa.concat_arrays([b.column("id").cast(pa.string()) for b in batches]) if batches else pa.array([], pa.string())
        own = ids.dictionary_encode()
        order = pc.sort_indices(own.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.of = own.dictionary.take(pa.array(order)), place[own.indices.to_numpy(zero_copy_only=False)]
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)])
        self.sizes = [join([b.column(c).value_lengths().to_numpy(zero_copy_only=False) for b in batches], np.int32) for c in "nac"]
        self.tokens = [join([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches], np.int64) for c in "nac"]


class _Index:
    """The targets of a cell by token. Tokens are numbered over both kinds, the rare first; ``lists`` gives the targets of tokens."""

    def __init__(self, rows: _Rows, cap: int):
        self.n, known, kinds, at, who = len(rows.of), [], [], [], []
        for kind in (NAME, ADDR, WHOLE):
            tokens, numbers = np.unique(rows.tokens[kind], return_inverse=True)
            at.append(numbers.astype(np.int32) + np.int32(sum(map(len, known))))
            who.append(np.repeat(np.arange(self.n, dtype=np.int32), rows.sizes[kind]))
            known.append(tokens)
            kinds.append(np.full(len(tokens), kind, np.int8))
        kinds, at, who = np.concatenate(kinds), np.concatenate(at), np.concatenate(who)
        df = np.bincount(at, minlength=len(kinds))
        common = (df * SHARE > self.n) & (kinds != WHOLE)
        order = np.lexsort((df, common))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.kinds, self.df = kinds[order], df[order]
        ends = np.cumsum([0, *map(len, known)])
        self.known = [(t, place[a:b]) for t, a, b in zip(known, ends, ends[1:], strict=False)]
        self.rare = len(order) - min(int(common.sum()), COMMON)
        at = place[at]
        self.targets = who[np.argsort(at, kind="stable")].astype(np.int64)
        self.start = np.cumsum(self.df) - self.df
        #: Weights by the number of targets, none beyond the cap: multiples of 2**-20, whose sums are exact in any order, and what is left of each.
        few = np.arange(1, min(cap, self.n) + 1)
        weight = np.zeros(self.n + 1)
        weight[few] = np.log1p(self.n / few)
        high = np.rint(weight * 2**20) / 2**20
        self.weight = np.stack([high, weight - high])
        self.held = np.zeros((len(order) - self.rare, self.n), np.uint8)
        held = at >= self.rare
        self.held[at[held] - self.rare, who[held]] = 1
        both = np.zeros((len(self.held),) * 2)
        for k in range(0, self.n, SLICE):
            part = self.held[:, k : k + SLICE].astype(float)
            both += part @ part.T
        both = both.astype(np.int64)
        self.both = [self.weight[0][both], self.weight[1][both].astype(np.float32)]

    def numbers(self, tokens: list[np.ndarray]) -> np.ndarray:
        """The numbers of a query's tokens that any target holds, in order."""
        out = []
        for own, (known, place) in zip(tokens, self.known, strict=True):
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            out.append(place[at[known[at] == own]] if len(known) else np.empty(0, np.int64))
        return np.sort(np.concatenate(out))

    def lists(self, numbers: np.ndarray) -> np.ndarray:
        many = self.df[numbers]
        upto = np.cumsum(many)
        return self.targets[np.repeat(self.start[numbers] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        """By part of the weight, family and target: the summed weights of the keys that the target shares with the query of these tokens."""
        out = np.zeros((2, 3, self.n))
        whole = numbers[self.kinds[numbers] == WHOLE]
        for k in whole:
            out[:, NAME, self.lists(np.array([k]))] += self.weight[:, self.df[k], None]
        numbers = numbers[self.kinds[numbers] != WHOLE]
        self._of_common(numbers[numbers >= self.rare], out)
        self._of_rare(numbers, out)
        return out[:, [0, 2, 1]]

    def _of_common(self, numbers: np.ndarray, out: np.ndarray) -> None:
        """Adds the keys of common tokens alone: each token, and each pair once."""
        n, a = (numbers[self.kinds[numbers] == kind] - self.rare for kind in (NAME, ADDR))
        for part, both in zip(out, self.both, strict=True):
            of_n, of_a, cross = np.triu(both[np.ix_(n, n)]), np.triu(both[np.ix_(a, a)]), both[np.ix_(n, a)]
            for k in range(0, self.n, SLICE):
                own = slice(k, k + SLICE)
                x, y = self.held[n, own].astype(both.dtype), self.held[a, own].astype(both.dtype)
                for row, left, weights, right in ((0, x, of_n, x), (1, x, cross, y), (2, y, of_a, y)):
                    part[row, own] += np.einsum("ij,ij->j", left, weights @ right)

    def _of_rare(self, numbers: np.ndarray, out: np.ndarray) -> None:
        """Adds the keys that hold a rare token: itself, and its pairs with each later token of the query that the target holds."""
        rare, bits = int(np.searchsorted(numbers, self.rare)), np.int64(max(1, len(numbers)).bit_length())
        if not rare:
            return
        own = np.sort((self.lists(numbers) << bits) | np.repeat(np.arange(len(numbers)), self.df[numbers]))
        at, local = own >> bits, own & ((1 << bits) - 1)
        first = np.flatnonzero(local < rare)
        many = np.searchsorted(at, at[first], side="right") - first
        upto, kinds = np.cumsum(many), self.kinds[numbers].astype(np.int64)
        cuts = [0, *np.flatnonzero(np.diff(upto // PAIRS)) + 1, len(first)]

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for a, b in zip(cuts, cuts[1:], strict=False):
                left = np.repeat(first[a:b], many[a:b])
                right = np.arange(len(left)) - np.repeat(np.cumsum(many[a:b]) - many[a:b] - first[a:b], many[a:b])
                x, y = local[left], local[right]
                yield x * len(numbers) + y, at[left], kinds[x] + kinds[y]

        held = [*parts()] if len(cuts) == 2 else None
        df = np.zeros(rare * len(numbers), np.int32)
        for key, _, _ in held or parts():
            if len(df) > PAIRS:
                np.add.at(df, key, 1)
            else:
                df += np.bincount(key, minlength=len(df)).astype(np.int32)
        for key, who, family in held or parts():
            held_by, place = df[key], family * self.n + who
            for part, weight in zip(out, self.weight, strict=True):
                part += np.bincount(place, weight[held_by], part.size).reshape(part.shape)


def pair_scores(records: DataFrame, cap: int = 3000) -> DataFrame:
    """``blocking.pair_scores`` with the keys of all tokens: (country, src, s1, t, s_name, s_addr, s_cross, s_tot). Rows of an id are summed."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            yield key[0].as_py(), key[1].as_py()
            batch = [(b.filter(b.column("query")), b.filter(pc.invert(b.column("query")))) for b in batches]
            queries, targets = (_Rows([b[k] for b in batch]) for k in range(2))
            batch.clear()
            if not len(targets.of) or not len(queries.of):
                return
            index = _Index(targets, cap)
            ends = [np.cumsum(s) for s in queries.sizes]
            rows, order = np.argsort(queries.of, kind="stable"), np.argsort(targets.of)
            for q, own in enumerate(np.split(rows, np.searchsorted(queries.of[rows], np.arange(1, len(queries.ids))))):
                sums = sum(index.sums(index.numbers([t[e[r] - s[r] : e[r]] for t, e, s in zip(queries.tokens, ends, queries.sizes, strict=True)])) for r in own)
                if len(targets.ids) < len(targets.of):
                    sums = np.stack([[np.bincount(targets.of, s, len(targets.ids)) for s in part] for part in sums])
                else:
                    sums = sums[:, :, order]
                sums = sums[0] + sums[1]
                found = np.flatnonzero(sums.any(axis=0))
                if len(found):
                    sums = [blocking._rounded(s[found]) for s in sums]
                    yield targets, queries, q, found, [*sums, blocking._rounded(sum(sums))]

        return blocking._batches(parts(), blocking._SUMS)

    cells, lands = _cells(records)
    cells = cells.repartition(PARTS, "land", "src", "block")
    return cells.groupBy("land", "src", "block").applyInArrow(run, blocking.SUMS).join(lands, "land").select("country", "src", "s1", "t", *[f"s_{f}" for f in blocking.FAMILIES], "s_tot")
