"""Vector rows for the searches: which take part, and how queries meet shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, components of a shard.
SHARD, QUERIES, VALUES = 8192, 2048, 2**22


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, vector) of rows with an id and a vector without null or non-finite components.

    Of rows that repeat an id the one with the least vector takes part. ``zero``: zero vectors too.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def numbered(rows: DataFrame, every: int, shard: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Candidates (shard, id, vector), queries (block, id, vector), and how many shards and blocks there are.

    Queries are the ids that ``every`` divides. The numbers follow the rows and their length, so a
    shard with a block of queries holds about ``SHARD`` + ``QUERIES`` rows at any size, fewer if they are long.
    """
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows_of = max(64, min(shard or SHARD, VALUES // max(1, dims or 1)))
    shards, blocks = max(1, -(-n // rows_of)), max(1, -(-n // every // (block or QUERIES)))
    queries = rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), queries, shards, blocks


def met(rows: DataFrame, every: int) -> DataFrame:
    """(shard, block, query, id, vector): each shard of candidates meets each block of the stated queries."""
    candidates, queries, shards, blocks = numbered(rows, every)
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(True).alias("query"), "id", "vector")
    candidates = candidates.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "id", "vector")
    return candidates.unionByName(queries)


def ranked(found: DataFrame, k: int, order) -> DataFrame:
    """The first ``k`` of each query over all shards; each shard sent at most k for a query."""
    window = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def split(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(query ids, query vectors, candidate ids, candidate vectors)."""
    q = pdf["query"].to_numpy(bool)
    ids, vectors = pdf["id"].to_numpy(), pdf["vector"].to_numpy()
    return ids[q], list(vectors[q]), ids[~q], list(vectors[~q])
