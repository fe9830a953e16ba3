"""Reports on decisions: samples of errors with both records, profiles of files and of the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = ("name", "addr", "country")


def show_pairs(pairs: DataFrame, records: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` pairs (s1, tgt, ...) by the hash of their ids, with name, address and country of both; a side that is missing is null."""
    taken = pairs.orderBy(F.xxhash64("s1", "tgt", F.lit(seed)), "s1", "tgt").limit(n)
    for key, k in (("s1", "a"), ("tgt", "b")):
        side = records.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{k}") for c in SHOWN])
        taken = taken.join(side, key, "left")
    return taken


def errors(pred: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, tgt, kind): false positives, and true pairs lost by the blocking or rejected by the matcher."""
    side = lambda df, name: df.select("s1", "tgt").distinct().withColumn(name, F.lit(True))
    both = side(pred, "chosen").join(side(truth, "true"), ["s1", "tgt"], "full").join(side(candidates, "met"), ["s1", "tgt"], "left")
    kind = F.when(F.col("true").isNull(), "fp").when(F.col("chosen").isNull(), F.when(F.col("met").isNull(), "fn_blocking").otherwise("fn_rejected"))
    return both.withColumn("kind", kind).where("kind is not null").select("s1", "tgt", "kind")


def error_samples(pred: DataFrame, truth: DataFrame, candidates: DataFrame, records: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Up to ``n`` errors of each kind, by the hash of their ids, with both records."""
    found = errors(pred, truth, candidates)
    out = None
    for kind in ("fp", "fn_blocking", "fn_rejected"):
        one = show_pairs(found.where(F.col("kind") == kind), records, n, seed)
        out = one if out is None else out.unionByName(one)
    return out


def truth_profile(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: pairs, queries, queries without a match and their share, the most matches of a query, targets of more than one query."""
    sizes = entities.select("s1").distinct().join(truth.groupBy("s1").agg(F.countDistinct("tgt").alias("n")), "s1", "left").fillna(0, ["n"])
    of_queries = sizes.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_s1"), F.sum((F.col("n") == 0).cast("int")).alias("n_single"), F.max("n").alias("most"))
    shared = truth.groupBy("tgt").agg(F.countDistinct("s1").alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("n_shared"))
    share = F.round(F.col("n_single") / F.greatest("n_s1", F.lit(1)), 6).alias("single_rate")
    return of_queries.join(shared).select("n_pairs", "n_s1", "n_single", share, "most", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))  # one row each


def file_profile(records: DataFrame, prefix: str) -> DataFrame:
    """One row for each country and one for all (null): rows, distinct ids, ids without the prefix, repeated name and address, empty addresses, lengths."""
    size = F.length("name")
    return records.rollup("country").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum((~F.col("id").startswith(prefix)).cast("int")).alias("bad_prefix"),
        (F.count("*") - F.countDistinct("name", "addr")).alias("repeats"), F.sum((F.col("addr") == "").cast("int")).alias("empty_addr"),
        F.round(F.percentile(size, F.lit(0.5)), 3).alias("p50"), F.round(F.percentile(size, F.lit(0.99)), 3).alias("p99"),
    )
