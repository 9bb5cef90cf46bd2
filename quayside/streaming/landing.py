"""Optional streaming form of the landing: events deduplicated within a watermark, panels rebuilt per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_events(spark: SparkSession, path: str, schema: str, late: str = "2 days") -> DataFrame:
    """Events of Parquet files as they arrive; repeats of an id within the watermark are dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["observation_id"])


def run_batches(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``on_batch``, until all present files are read."""
    return events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
