"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset (as in tests) a folder of this machine is taken, and only for a local master.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir", "")
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "linkforge-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A place in the shared folder for tables of ``stored`` that are deleted at the end; what is returned must not read them any more."""
    path = os.path.join(folder(spark), f"scratch-{uuid.uuid4().hex}")
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, within: str | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder, smaller than a checkpoint; columns without a type are nulls again."""
    path = os.path.join(within or folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    typed = [f.name for f in df.schema if f.dataType.typeName() != "void"]
    df.select(*typed).write.parquet(path)
    back = df.sparkSession.read.schema(df.select(*typed).schema).parquet(path)
    return back.select(*[F.col(c) if c in typed else F.lit(None).alias(c) for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of long texts fits; Spark bounds a batch itself by its bytes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, limit: int) -> DataFrame:
    """Join with ``right`` broadcast only if its counted ``rows`` stay within ``limit``; else shuffled."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)
