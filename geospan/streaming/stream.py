"""Streams: stages without state run as they are; those that group a document's spans run by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import patterns


def life(docs: DataFrame) -> DataFrame:
    """Identifiers in a stream of documents; no state."""
    return patterns.life(docs)


def by_batch(docs: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A whole query on each micro-batch, written under its number: a batch that is run again replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by hour and type; (start, event_type, n, total)."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
