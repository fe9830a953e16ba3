"""Checks of result lists and files: a row for each finding, with severity, count and up to five examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Findings in the order of the report; the last only warns.
FINDINGS = ("duplicate_row", "duplicate_id", "empty_id", "self_match", "wrong_prefix", "unknown_id", "missing_s1", "extra_s1", "not_candidate")
EXAMPLES = 5


def _found(rows: DataFrame, name: str, column: str = "id") -> DataFrame:
    return rows.select(F.lit(name).alias("finding"), F.col(column).cast("string").alias("id"))


def _report(found: DataFrame, warn: tuple[str, ...] = ("not_candidate",)) -> DataFrame:
    """Counts, and the least ids by a count for each id first, so that no task holds all ids of a finding."""
    names = F.explode(F.array(*map(F.lit, FINDINGS))).alias("finding")
    counts = found.groupBy("finding").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("finding").orderBy("id"))
    few = found.distinct().withColumn("place", place).where(F.col("place") <= EXAMPLES)  # a limit of each group: cut before the shuffle
    least = few.groupBy("finding").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    out = found.sparkSession.range(1).select(names).join(counts, "finding", "left")
    severity = F.when(F.col("finding").isin(*warn), "warn").otherwise("error").alias("severity")
    return out.join(least, "finding", "left").select("finding", severity, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def validate_lists(lists: DataFrame, column: str, entities: DataFrame, targets: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``lists``: (s1, column), a comma list; ``entities``: (s1); ``targets``: (tgt); ``candidates``: (s1, tgt). Counts of zero are reported too."""
    ids = lists.where(F.col(column) != "").select("s1", F.explode(F.split(column, ",", -1)).alias("tgt"))
    kind: Column = F.when(F.col("tgt") == "", "empty_id").when(F.col("tgt").startswith("S1-"), "self_match").when(~F.col("tgt").rlike("^S[123]-"), "wrong_prefix")
    of_ids = ids.withColumn("finding", kind).where("finding is not null")
    found = of_ids.select("finding", F.when(F.col("finding") == "empty_id", F.col("s1")).otherwise(F.col("tgt")).alias("id"))
    named = ids.where("tgt <> ''")
    rows = lists.groupBy("s1").agg(F.count("*").alias("n"))
    found = found.unionByName(_found(rows.where("n > 1"), "duplicate_row", "s1"))
    found = found.unionByName(_found(named.groupBy("s1", "tgt").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id", "tgt"))
    found = found.unionByName(_found(named.join(targets.select("tgt").distinct(), "tgt", "left_anti"), "unknown_id", "tgt"))
    every = entities.select("s1", F.lit(True).alias("known")).distinct().join(rows, "s1", "full")
    found = found.unionByName(every.where("known is null or n is null").select(F.when(F.col("n").isNull(), "missing_s1").otherwise("extra_s1").alias("finding"), F.explode(F.array_repeat("s1", F.coalesce("n", F.lit(1)).cast("int"))).alias("id")))
    if candidates is not None:
        found = found.unionByName(_found(not_subset(named, candidates), "not_candidate", "tgt"))
    return _report(found)


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (s1, tgt) that are matched but no candidates."""
    return matches.select("s1", "tgt").distinct().join(candidates.select("s1", "tgt"), ["s1", "tgt"], "left_anti")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of a file from 0, numbered without bringing them together."""
    lines = spark.read.text(path).withColumn("m", F.monotonically_increasing_id())
    part, own = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    starts, at = [], 0
    for r in sizes:
        starts.append((r["part"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, first long"))
    return lines.withColumn("part", part.cast("long")).join(offsets, "part").select((F.col("first") + own).alias("place"), "value")


def read_lists(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """(place, s1, ids) of a tab-separated file of lists, and (finding, n, examples) of its format."""
    lines = placed_lines(spark, path)
    first = lines.where("place = 0").collect()
    problem = "no such row" if not first else None
    if first:
        head = first[0]["value"]
        if "\t" not in head and "," in head:
            problem = "comma-separated"
        elif [c.strip().lower() for c in head.split("\t")] != header:
            problem = head
    data = lines.where("place > 0 and trim(value) <> ''")
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))
    bad = data.where(tabs != 1).select(F.concat_ws(":", (F.col("place") + 1).cast("string"), F.substring("value", 1, 40)).alias("id"), "place")
    examples = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",")
    broken = bad.agg(F.count("*").alias("n")).join(bad.orderBy("place").limit(EXAMPLES).agg(examples.alias("examples")))  # one row each
    format_ = spark.createDataFrame([("bad_header", int(problem is not None), problem or "")], "finding string, n long, examples string")
    format_ = format_.unionByName(broken.select(F.lit("malformed_row").alias("finding"), "n", F.coalesce("examples", F.lit("")).alias("examples")))
    cells = F.split("value", "\t", -1)
    return data.where(tabs == 1).select("place", cells[0].alias("s1"), cells[1].alias("ids")), format_


def validate_files(spark: SparkSession, matches: str, candidates: str, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, finding, severity, n, examples) of both result files: format, lists, and whether their rows go in step."""
    out, read = None, {}
    for name, path, column in (("matches", matches, "matched_entity_ids"), ("candidates", candidates, "candidate_entity_ids")):
        rows, format_ = read_lists(spark, path, ["source1_entity_id", column])
        read[name] = rows
        one = format_.withColumn("severity", F.lit("error")).unionByName(validate_lists(rows, "ids", entities, targets))
        one = one.where("finding <> 'not_candidate'").withColumn("file", F.lit(name))
        out = one if out is None else out.unionByName(one)
    side = lambda name, k: read[name].select("place", F.col("s1").alias(f"s1_{k}"))
    apart = side("matches", "a").join(side("candidates", "b"), "place", "full").where("not (s1_a <=> s1_b)")
    pairs = lambda name: read[name].where("ids <> ''").select("s1", F.explode(F.split("ids", ",", -1)).alias("tgt"))
    lost = not_subset(pairs("matches"), pairs("candidates"))
    for name, rows, column, order in (("out_of_step", apart, F.coalesce("s1_a", "s1_b"), "place"), ("not_candidate", lost, F.col("tgt"), "tgt")):
        few = rows.orderBy(order).limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias("examples"))
        one = rows.agg(F.count("*").alias("n")).join(few)  # one row each
        out = out.unionByName(one.select(F.lit(name).alias("finding"), "n", F.coalesce("examples", F.lit("")).alias("examples"), F.lit("error").alias("severity"), F.lit("both").alias("file")))
    return out.select("file", "finding", "severity", "n", "examples")


def verdict(report: DataFrame) -> bool:
    """Whether no finding of severity error has a count."""
    return report.where("severity = 'error' and n > 0").isEmpty()
