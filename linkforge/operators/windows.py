"""Competition windows: top two of a group, gaps, margins, ranks, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top2(df: DataFrame, by: list[str], value: str, ties: list[str], prefix: str) -> DataFrame:
    """Adds prefix_gap (max - value), prefix_margin (over the second if first, else under the first), prefix_rank from 0.

    The second of a single row is -1.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, first = F.col(value), F.max(value).over(whole)
    second, rank = F.coalesce(F.nth_value(value, 2).over(whole), F.lit(-1.0)), F.row_number().over(order) - 1
    return df.withColumns(
        {f"{prefix}_gap": F.round(first - v, 6), f"{prefix}_margin": F.round(F.when(rank == 0, v - second).otherwise(v - first), 6), f"{prefix}_rank": rank.cast("int")}
    )


def filter_features(pool: DataFrame) -> DataFrame:
    """Competition of the candidates of a query and source, and of the queries of a target."""
    own, target = ["s1", "src"], ["src", "t"]
    out = pool.withColumn("n_pool", F.count("*").over(Window.partitionBy(*own)))
    for column, name in (("s_tot", "tot"), ("s_name", "name"), ("s_addr", "addr")):
        out = top2(out, own, column, ["t"], "x").withColumnRenamed("x_gap", f"g_{name}")
        out = out.withColumnRenamed("x_margin", "m_tot").drop("x_rank") if name == "tot" else out.drop("x_margin", "x_rank")
    out = out.withColumn("t_n", F.count("*").over(Window.partitionBy(*target)))
    return top2(out, target, "s_tot", ["s1"], "t").drop("t_gap")


def target_side(candidates: DataFrame) -> DataFrame:
    out = candidates.withColumn("t_n_s1", F.count("*").over(Window.partitionBy("src", "t")))
    return top2(out, ["src", "t"], "s_tot", ["s1"], "t_s_total").drop("t_s_total_gap")


def query_side(candidates: DataFrame, values: list[str]) -> DataFrame:
    out = candidates.withColumn("c_n_cands", F.count("*").over(Window.partitionBy("s1", "src")))
    for v in values:
        out = top2(out, ["s1", "src"], v, ["t"], f"c_{v}")
    return out


#: Values whose competition among a query's candidates of a source is a feature.
CONTEXT = ("s_total", "n_tset", "quick", "a_ptset", "n_ratio")


def query_context(df: DataFrame) -> DataFrame:
    """Adds s_total, quick and the competition among all candidates of a query: of a source, and for quick of all sources."""
    quick = (F.col("n_tset") + F.greatest("a_ptset", F.lit(0.0))) / 2
    out = query_side(df.withColumns({"s_total": F.round(F.col("s_name") + F.col("s_addr") + F.col("s_cross"), 6), "quick": quick}), list(CONTEXT))
    out = top2(out, ["s1"], "quick", ["src", "t"], "x")
    return out.withColumnRenamed("x_gap", "c_quick_gap_all").withColumnRenamed("x_rank", "c_quick_rank_all").drop("x_margin")


#: What ``p_context`` adds to p1.
P_CONTEXT = ("p1_gap", "p1_margin", "p1_rank", "p1_gap_src", "p1_rank_src", "p1_other_max", "p1_sum", "p1_n50", "p1_n80")


def p_context(scored: DataFrame, p: str = "p1") -> DataFrame:
    """Context of a first-stage probability among all candidates of a query."""
    out = top2(scored, ["s1"], p, ["src", "t"], p)
    out = top2(out, ["s1", "src"], p, ["t"], "x").withColumnRenamed("x_gap", f"{p}_gap_src").withColumnRenamed("x_rank", f"{p}_rank_src").drop("x_margin")
    all_, v = Window.partitionBy("s1"), F.col(p)
    return out.withColumns(
        {
            f"{p}_other_max": F.round(v - F.col(f"{p}_margin"), 6),
            f"{p}_sum": F.round(F.sum(p).over(all_), 6),
            f"{p}_n50": F.sum((v >= 0.5).cast("int")).over(all_),
            f"{p}_n80": F.sum((v >= 0.8).cast("int")).over(all_),
        }
    )
