"""A corpus pipeline of five stages, each by one operator of ``linkforge.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
documents; ``run`` writes each to the folder that executors share, reads it again, and deletes it when
the next one is written.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import line_dedup, ngram_join, packing, queries, secret_scans, toxicity
from linkforge.llm.common import cut, join_small, text_or_empty


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text has it now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model learns from the labels that are not held out.

    A null or empty text is scored like any other, repeated rows each.
    """
    return toxicity.reject_toxic(docs, queries.toxicity_model(spark, sf_dir))


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called that."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows and of 51-word passages go; a document of which nothing is left goes too.

    Null, empty and blank texts that were so before stay; rows that repeat a doc_id and its text are cut alike.
    """
    removed, went = _fresh(docs, "removed"), _fresh(docs, "went")
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\v\f")) == ""
    after = line_dedup.line_dedup(docs, removed_col=removed, words_col=went)
    return _recounted(after.where(~blank | ((F.size(removed) == 0) & (F.col(went) == 0)))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingles at 0.8 the row of the least doc_id stays, and of rows equal in doc_id and text one.

    A row is told by its doc_id and text, so a doc_id with several texts loses only those that are
    copies. Rows of a null doc_id stay. Of equal rows the least by their other columns stays.
    """
    id_, mark = _fresh(docs, "id"), _fresh(docs, "mark")
    found = cut(ngram_join.ngram_rows(docs, width=5, num=8, den=10).where("doc_id is not null").groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.min("leads").alias("leads"), F.count("*").alias("times")))
    gone, twice = found.where("not leads").select(id_, mark), found.where("leads and times > 1").select(id_, mark)
    marked = docs.withColumns({id_: F.col("doc_id").cast("long"), mark: F.xxhash64(text_or_empty())})
    kept = join_small(marked, gone, [id_, mark], "left_anti", gone.count(), ngram_join.SMALL)
    times = twice.count()
    if not times:
        return kept.select(*docs.columns)
    whole = F.struct(*[kept[c] for c in docs.columns])
    one = join_small(kept, twice, [id_, mark], "left_semi", times, ngram_join.SMALL).groupBy(id_, mark).agg(F.min_by(whole, F.to_json(whole)).alias(id_ + "row"))
    return join_small(kept, twice, [id_, mark], "left_anti", times, ngram_join.SMALL).select(*docs.columns).unionByName(one.select(f"{id_}row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones and null texts too; spans of secrets become a mark."""
    return _recounted(secret_scans.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, as ``packing.pack``; a null or empty text is the separator alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
#: SQL has no classifier, tokenizer or packing: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut(spark.range(1))  # sets a checkpoint folder where none is set
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the next stage has read is no longer needed
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
