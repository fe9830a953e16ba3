"""Approximate nearest neighbours by a vantage-point tree on each shard.

A node holds a few vantage points, chosen for the spread of their distances, and splits its rows at
the median distance to the one of greatest spread. Each row keeps its distances to all vantage points
above it, each side of a node the least and greatest of them. For a query and a row that lie d and e
from a vantage point, the triangle inequality says that they are |d - e| apart at least; the greatest
such gap rules out a side, or a row of a leaf, if factor * gap > r, with r the distance of the k-th
neighbour found so far. Factor 1 is exact; larger factors rule out more and miss some. Nodes are taken
by least gap. A tree is built once for each shard and sent to the blocks of queries; the shards' lists
are merged.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor rows without an id; of rows that repeat an id the least vector counts; vectors of another
length than the query's are no candidates; equal distances go by the smaller id; an empty table gives
no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import cut
from linkforge.llm.vectors import numbered, ranked, usable

#: Rows of a leaf, vantage points of a node, rows tried for each, rows that their spread is measured on.
LEAF, VANTAGES, TRIED, PROBES = 512, 32, 8, 100
#: What rounding may add to a gap.
SLACK = 1e-9


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = rows - query
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """A vantage-point tree over rows of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF, vantages: int = VANTAGES, seed: int = 7):
        self.rows, self.ids, self.leaf, self.vantages = rows, ids, leaf, vantages
        random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(rows)), np.empty((len(rows), 0)), random)

    def _vantage(self, at: np.ndarray, random: np.random.Generator) -> np.ndarray:
        some = lambda n: at[random.choice(len(at), min(n, len(at)), replace=False)]
        tried, probes = some(TRIED), self.rows[some(PROBES)]
        return self.rows[max(tried.tolist(), key=lambda i: distances(probes, self.rows[i]).std())]

    def _build(self, at: np.ndarray, path: np.ndarray, random: np.random.Generator):
        if len(at) <= self.leaf:
            return at, path
        vantages = np.stack([self._vantage(at, random) for _ in range(self.vantages)])
        to = np.stack([distances(self.rows[at], v) for v in vantages], axis=1)
        by = to[:, to.std(axis=0).argmax()]
        inside = by < np.median(by)
        if not inside.any() or inside.all():  # ties only: halves of equal rows
            inside = np.arange(len(at)) < len(at) // 2
        path = np.hstack([path, to])
        sides = [(to[s].min(axis=0), to[s].max(axis=0), self._build(at[s], path[s], random)) for s in (inside, ~inside)]
        return vantages, sides, None

    def nearest(self, query: np.ndarray, own: int, k: int, factor: float) -> tuple[list[tuple[float, int]], int]:
        """(distance, id) of the k nearest, ties to the smaller id, ``own`` left out; and the rows and vantage points compared."""
        best: list[tuple[float, int]] = []  # max-heap of (-distance, -id)
        todo, n, compared = [(0.0, 0, self.root, np.empty(0))], 0, 0
        while todo:
            gap, _, node, path = heapq.heappop(todo)
            limit = -best[0][0] * (1 + SLACK) + SLACK if len(best) == k else np.inf
            if factor * gap > limit:
                break  # the heap gives the least gap first: the rest is ruled out too
            if len(node) == 2:
                at, to = node
                if len(path) and limit < np.inf:
                    at = at[factor * np.abs(to - path).max(axis=1) <= limit]
                compared += len(at)
                d = distances(self.rows[at], query)
                for i in np.flatnonzero(d <= -best[0][0]) if len(best) == k else range(len(at)):
                    if self.ids[at[i]] != own:
                        item = (-float(d[i]), -int(self.ids[at[i]]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                continue
            vantages, sides, _ = node
            d = distances(vantages, query)
            compared += len(d)
            for low, high, side in sides:
                n += 1
                heapq.heappush(todo, (max(gap, float(np.maximum(low - d, d - high).max())), n, side, np.append(path, d)))
        return sorted((-d, -i) for d, i in best), compared


def searched(vectors: DataFrame, k: int, every: int, factor: float, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, vec_id, score, compared) of the k nearest of each shard; ``compared`` is given once for each query and shard."""
    rows = cut(usable(vectors, id_col, vector_col, zero=False))
    candidates, queries, shards, blocks = numbered(rows, every)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["vector"].map(len)
        trees = {int(n): Tree(np.stack(part["vector"].tolist()), part["id"].to_numpy()) for n, part in pdf.groupby(sizes)}
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "tree": [pickle.dumps(trees)]})

    def search(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = []
        for own in map(pickle.loads, trees["tree"]):
            for q, v in zip(queries["id"], queries["vector"], strict=True):
                if len(v) in own:
                    near, compared = own[len(v)].nearest(v, q, k, factor)
                    found += [(q, i, d, compared if j == 0 else 0) for j, (d, i) in enumerate(near)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "compared"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "compared": "int64"})

    trees = cut(candidates.groupBy("shard").applyInPandas(build, "shard int, tree binary"))
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ("shard", "block")
    return asked.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double, compared long")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose id ``every`` divides; every row is indexed."""
    found = searched(vectors, k, every, factor, id_col, vector_col)
    return ranked(found, k, F.col("score").asc()).select("query_id", "rank", "vec_id", "score")
