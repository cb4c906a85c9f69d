"""Incremental ingestion of manifests: each new one once, however often the stream is restarted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, *, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(path)


def distinct_stream(rows: DataFrame, keys: Sequence[str], *, event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """First row of each key; with an event time the state is dropped behind the watermark."""
    if event_time is None:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(keys))


def run_available(rows: DataFrame, output: str, checkpoint: str) -> None:
    """Everything that is there now, into a Parquet table; the checkpoint remembers what was done."""
    rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def status_counts(events: DataFrame) -> DataFrame:
    """planned, reused, downloaded, failed and completed of a state table (status)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return events.agg(F.count("*").alias("planned"), n("reused").alias("reused"), n("downloaded").alias("downloaded"), n("failed").alias("failed"), (n("reused") + n("downloaded")).alias("completed"))
