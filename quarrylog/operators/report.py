"""Small derived results for displays: filters, bars, labels, top commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.severity import SEVERITY_RULES

# Display names of the formats.
FORMAT_LABELS = {"json": "JSON", "nginx": "Nginx", "apache": "Apache", "syslog": "Syslog", "text": "Plain Text", "unknown": "Unknown"}


def by_severity(rows: DataFrame, severity: str) -> DataFrame:
    return rows if severity == "All" else rows.where(F.col("severity") == severity)


def relative_bar(rows: DataFrame) -> DataFrame:
    """``bar``: occurrences against the source's largest, in percent, at least 4."""
    most = F.greatest(F.max("occurrences").over(Window.partitionBy("source_id")), F.lit(1))
    return rows.withColumn("bar", F.greatest(F.col("occurrences") / most * 100, F.lit(4.0)))


def top_commands(commands: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.desc("occurrences"), "first_line")
    return commands.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def format_label(fmt: Column) -> Column:
    out = fmt
    for name, label in FORMAT_LABELS.items():
        out = F.when(fmt == name, label).otherwise(out)
    return out


def confidence_percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("long")


def confidence_tag(is_high: Column) -> Column:
    return F.when(~is_high, "possible match")


def funnel(groups: DataFrame, issues: DataFrame) -> DataFrame:
    """Per source: error groups, fingerprints, issues."""
    left = groups.groupBy("source_id").agg(F.count("*").alias("error_groups"))
    return left.join(issues.groupBy("source_id").agg(F.sum("fingerprints").alias("fingerprints"), F.count("*").alias("issues")), "source_id", "left").na.fill(0)


def bucket_label(start: Column) -> Column:
    return F.date_format(start.cast("timestamp"), "MMM d, HH:mm")


def frame_text(frame: Column) -> Column:
    return F.concat_ws(" @ ", frame["function_name"], F.concat_ws(":", frame["file_name"], frame["line_number"].cast("string"), frame["column_number"].cast("string")))


def context_line(command: Column, timestamp: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" · ", command, timestamp), F.lit("")), F.lit("No command context"))


def size_kb(length: Column) -> Column:
    return F.round(length / 1024, 1)


def issue_detail(issues: DataFrame, placeholder: str = "No service named") -> DataFrame:
    """Per issue the number of its variants, its services in one text (or ``placeholder``) and its first raw line."""
    names = F.coalesce(F.nullif(F.array_join("affected_services", ", "), F.lit("")), F.lit(placeholder))
    return issues.select("source_id", "fingerprint", F.size("related_errors").cast("long").alias("variants"), names.alias("services"), F.get("raw_samples", F.lit(0)).alias("sample"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.pattern, r.severity, r.is_regex) for r in SEVERITY_RULES], "pattern string, severity string, is_regex boolean")
