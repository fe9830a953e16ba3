"""Exact top-k search by term-at-a-time accumulation.

A component is a term, its integer weight floor(scale * x). In each shard of candidates a term's
postings are its rows of non-zero weight. A query goes through its non-zero terms and scatters weight
times weight into a dense array of scores, one for each row of the shard; a partition selection keeps
the k best (ties to the smaller id), and the shards' lists are merged. Every query meets every row.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part,
nor rows without an id; of rows that repeat an id the least vector counts; a component that a shorter
vector lacks is zero; scores beyond a long are held at its ends; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import cut
from linkforge.llm.vectors import met, ranked, split, usable

LONG = 2**63 - 1


def weights(vectors: list[np.ndarray], dims: int, scale: float) -> np.ndarray:
    """Integer weights; Python integers where a product could pass a long."""
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x = np.floor(x * scale)
    if not x.size or np.abs(x).max() < 2**28:
        return x.astype(np.int64)
    return np.array([[int(c) if np.isfinite(c) else int(np.sign(c)) * 2**1100 for c in row] for row in x], dtype=object)


def scores_of(query: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], rows: int) -> np.ndarray:
    """One query's score with every row: its terms' postings, weighted, added up."""
    scores = np.zeros(rows, query.dtype if query.dtype == object else np.int64)
    for term in np.flatnonzero(query):
        where, weight = postings[term]
        if where is None:
            scores += weight * query[term]
        else:
            scores[where] += weight * query[term]
    return scores


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best rows for each query, the query's own id left out."""
    order = np.argsort(ids)
    rows, ids = rows[order], ids[order]
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for term in range(rows.shape[1]):
        where = np.flatnonzero(rows[:, term])
        # A term that most rows hold is added in place without positions.
        postings.append((None, np.ascontiguousarray(rows[:, term])) if 2 * len(where) > len(rows) else (where, rows[where, term]))
    out = []
    for q, own in zip(queries, query_ids, strict=True):
        scores = scores_of(q, postings, len(ids))
        at = np.searchsorted(ids, own)
        other = np.ones(len(ids), bool)
        other[at : at + 1] = ids[at : at + 1] != own
        candidates = np.flatnonzero(other)
        if len(candidates) > k:
            least = np.partition(scores[candidates], len(candidates) - k)[len(candidates) - k]
            candidates = candidates[scores[candidates] >= least]  # with all ties at the edge
        best = sorted(((-scores[i], ids[i]) for i in candidates))[:k]
        out += [(int(own), int(i), max(-LONG - 1, min(LONG, int(-s)))) for s, i in best]
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose id ``every`` divides."""
    rows = cut(usable(vectors, id_col, vector_col, zero=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        query_ids, queries, ids, candidates = split(pdf)
        found = []
        if len(query_ids) and len(ids):
            dims = max(map(len, [*queries, *candidates]))
            q, c = weights(queries, dims, scale), weights(candidates, dims, scale)
            if q.dtype != c.dtype:
                q, c = q.astype(object), c.astype(object)
            found = search(q, query_ids, c, ids, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = met(rows, every).groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score long")
    return ranked(found, k, F.col("score").desc()).select("query_id", "rank", "vec_id", "score")
