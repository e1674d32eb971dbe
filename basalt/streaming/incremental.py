"""Streaming forms of the batch loads (an extension; the batch forms come first)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.merge import VersionedTable, latest


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling one-day windows by event type with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("event_type", F.to_date("window.start").alias("day"), "n", "top")


def load_available(spark: SparkSession, folder: str, schema: str, target: str, keys: list[str], checkpoint: str, order: str) -> int:
    """Take all files not seen before into a keyed table, in micro-batches, then stop.

    Of several rows for one key in a batch the last by ``order`` counts. Returns the batches taken;
    the checkpoint makes a second call take none.
    """
    table, taken = VersionedTable(spark, target), []

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(latest(batch, keys, [F.desc(order)]), keys)
            taken.append(number)

    q = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(taken)
