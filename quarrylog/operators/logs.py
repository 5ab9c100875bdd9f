"""The log pipeline: parsed lines, counters, error groups, time buckets, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsing
from ..functions.patterns import is_blank, staged, trim
from ..functions.severity import ERROR_LEVELS, classify_severity

SAMPLE_LINES = 50
UNLABELED = "(unlabeled error)"
HOUR_MS = 3_600_000


def with_format(lines: DataFrame) -> DataFrame:
    return lines.withColumn("format", parsing.line_format(F.col("raw")))


def detect_format(lines: DataFrame) -> DataFrame:
    """(source_id, detected_format): the commonest format of the first lines, the earlier seen on a tie."""
    head = staged(lines.where(F.col("line_number") <= SAMPLE_LINES), format=parsing.line_format(F.col("raw")))
    counts = head.where("format IS NOT NULL").groupBy("source_id", "format").agg(F.count("*").alias("n"), F.min("line_number").alias("seen"))
    best = counts.groupBy("source_id").agg(F.min(F.struct(-F.col("n"), "seen", "format")).alias("best"))
    return lines.select("source_id").distinct().join(best, "source_id", "left").select("source_id", F.coalesce("best.format", F.lit("unknown")).alias("detected_format"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with level, timestamp, message and normalized_message."""
    p = parsing.parse(F.col("raw"), F.col("format"))
    read = staged(with_format(lines.where(~is_blank(F.col("raw")))), level=p.level, timestamp=p.timestamp)
    # Plain projections: who only counts levels never makes a message, and filters on the level come before them.
    return read.withColumn("message", p.message).withColumn("normalized_message", parsing.normalized(F.col("format"), F.col("message")))


def line_counters(lines: DataFrame) -> DataFrame:
    blank = is_blank(F.col("raw"))
    return lines.groupBy("source_id").agg(F.count_if(~blank).alias("total_lines"), F.count_if(blank).alias("blank_lines"))


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id", "level").agg(F.count("*").alias("n"))


def headline(entries: DataFrame) -> DataFrame:
    level = F.col("level")
    return entries.groupBy("source_id").agg(
        F.count_if(level.isin(*ERROR_LEVELS)).alias("error_count"), F.count_if(level.isin("CRITICAL", "FATAL")).alias("critical_count"), F.count_if(level == "WARN").alias("warning_count")
    )


def error_groups(entries: DataFrame) -> DataFrame:
    """Errors of one level and one normalized message; the attributes are those of the first line."""
    stamp = F.nullif("timestamp", F.lit(""))
    first = F.min_by(F.struct("message", "normalized_message", "raw"), "line_number")
    groups = (
        entries.where(F.col("level").isin(*ERROR_LEVELS)).groupBy("source_id", "level", F.lower("normalized_message").alias("group_key"))
        .agg(F.count("*").alias("occurrences"), F.min(stamp).alias("first_occurrence"), F.max(stamp).alias("last_occurrence"), F.min("line_number").alias("first_line"), first.alias("f"))
    )
    message = F.coalesce(F.nullif("f.message", F.lit("")), F.lit(UNLABELED))
    return groups.select(
        "source_id", "level", message.alias("message"), F.col("f.normalized_message").alias("normalized_message"), classify_severity(F.col("level"), F.col("f.message")).alias("severity"),
        "occurrences", "first_occurrence", "last_occurrence", "first_line", trim(F.col("f.raw")).alias("sample_raw"),
    )


def time_buckets(entries: DataFrame, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Counts per bucket of event time in UTC; lines without a valid date and time are left out."""
    timed = staged(entries, at=F.unix_millis(parsing.event_time(F.col("timestamp")))).where("at IS NOT NULL")
    start = F.timestamp_millis(F.floor(F.col("at") / bucket_ms) * bucket_ms)
    error, warn = F.col("level").isin(*ERROR_LEVELS), F.col("level") == "WARN"
    return timed.groupBy("source_id", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("start")).agg(
        F.count_if(error).alias("error_count"), F.count_if(warn).alias("warn_count"), F.count_if(~error & ~warn).alias("info_count"), F.count("*").alias("total_count")
    )


def error_frequency(groups: DataFrame) -> DataFrame:
    """Rank and percentage of every error group of a source."""
    mine = Window.partitionBy("source_id")
    share = F.col("occurrences") / F.sum("occurrences").over(mine)
    return groups.select(
        "source_id", F.row_number().over(mine.orderBy(F.desc("occurrences"), "first_line")).cast("long").alias("rank"), "message", "normalized_message",
        F.col("occurrences").alias("count"), (F.floor(share * 1000 + 0.5) / 10).alias("percentage"),
    )


def summary(lines: DataFrame) -> DataFrame:
    """One row per source: counters, detected format and the number of error groups."""
    entries = parse_lines(lines)
    unique = error_groups(entries).groupBy("source_id").agg(F.count("*").alias("unique_error_count"))
    out = line_counters(lines).join(headline(entries), "source_id", "left").join(unique, "source_id", "left").join(detect_format(lines), "source_id")
    return out.na.fill(0, ["error_count", "critical_count", "warning_count", "unique_error_count"]).withColumn("processed_at", F.current_timestamp())
