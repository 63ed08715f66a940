"""Streams of records: the same identity rules as the batch operators, over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import records


def deduplicated(items: DataFrame, at: str = "arrived", late: str = "1 hour") -> DataFrame:
    """A stream of items without repeats of a safe URL and body hash within the watermark."""
    x = records.identified(items).where("body is not null").withWatermark(at, late)
    return x.dropDuplicatesWithinWatermark(["platform", "safe_url", "content_hash"])


def outcome_counts(attempts: DataFrame, at: str = "arrived", window: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of outcomes by time window; a window is given out once it can't change."""
    return attempts.withWatermark(at, late).groupBy(F.window(at, window), "outcome").agg(F.count("*").alias("n"))


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet table, exactly once, for all that is there now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
