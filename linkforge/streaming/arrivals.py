"""Structured Streaming: new records of source 1 against a static key index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators import blocking


def score_arrivals(stream: DataFrame, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5):
    """Starts a query that ranks each micro-batch of records. ``index``: postings of targets with idf."""

    def run(batch: DataFrame, number: int) -> None:
        keys = blocking.postings(batch.withColumn("src", F.lit(1)))
        stats = index.select("country", "src", "fam", "key", "idf").distinct()
        found = blocking.ranked(blocking.scores(keys, index.drop("idf"), stats))
        sink(blocking.cut(found, k, 0, 0), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
