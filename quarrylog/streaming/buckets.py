"""Hourly counts over a stream of lines (beyond the batch pipeline)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.severity import ERROR_LEVELS
from ..operators.logs import parse_lines


def streaming_buckets(lines: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``lines``: source_id, line_number, raw, as a stream. Counts per source and window of event time."""
    timed = parse_lines(lines).withColumn("at", parsing.event_time(F.col("timestamp"))).where("at IS NOT NULL")
    error = F.col("level").isin(*ERROR_LEVELS)
    counted = timed.withWatermark("at", late).groupBy("source_id", F.window("at", width).alias("w"))
    return counted.agg(F.count_if(error).alias("error_count"), F.count("*").alias("total_count")).select("source_id", F.col("w.start").alias("start"), "error_count", "total_count")
