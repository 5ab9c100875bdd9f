"""Sources, input checks, line splitting and the JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import is_blank

# Accepted endings and the largest input (bytes of a file, characters of pasted text).
EXTENSIONS = ("log", "txt", "json", "jsonl")
MAX_SIZE = 15 * 1024 * 1024
PASTED_NAME = "pasted-log.txt"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, file_name, length, content) of whole files."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), name.alias("file_name"), "length", F.decode("content", "UTF-8").alias("content"))


def pasted(df: DataFrame, text: str = "text", source_id: str = "source_id") -> DataFrame:
    """Pasted text as files of one name; null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(source_id).alias("source_id"), F.lit(PASTED_NAME).alias("file_name"), F.length(body).cast("long").alias("length"), body.alias("content"))


def json_bodies(df: DataFrame, body: str = "body", source_id: str = "source_id") -> DataFrame:
    """Bodies of the form {"text": "..."} as files; anything else is an empty text."""
    parsed = F.try_parse_json(F.col(body))
    text = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant")) == "STRING", F.try_variant_get(parsed, "$.text", "string"))
    return pasted(df.select(F.col(source_id).alias("source_id"), F.coalesce(text, F.lit("")).alias("text")))


def sample(spark: SparkSession) -> DataFrame:
    """A small log of our own, as a file."""
    rows = [f"2026-03-04 08:{m:02}:00 {level} {message}" for m, (level, message) in enumerate(SAMPLE)]
    return spark.createDataFrame([("sample", "sample.log", "\n".join(rows))], "source_id string, file_name string, content string").select("source_id", "file_name", F.length("content").cast("long").alias("length"), "content")


SAMPLE = (
    ("INFO", "service started"), ("ERROR", "Database connection failed for user 41007"), ("WARN", "slow query on orders"), ("ERROR", "Database connection failed for user 52311"),
    ("FATAL", "out of memory in worker 3"), ("INFO", "retry scheduled"), ("ERROR", "connection refused by kafka:9092"),
)


def accepted_name(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(EXTENSIONS)})$")


def rejection(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """``files`` with status and error; both null where the input is accepted."""
    bad_name, large, blank = ~accepted_name(F.col("file_name")), F.col("length") > max_size, is_blank(F.col("content"))
    status = F.when(bad_name, 400).when(large, 413).when(blank, 400)
    error = F.when(bad_name, "unsupported file type").when(large, "file too large").when(blank, "empty input")
    return files.withColumns({"status": status, "error": error})


def accepted(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    return rejection(files, max_size).where("status IS NULL").drop("status", "error")


def rejects(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    return rejection(files, max_size).where("status IS NOT NULL").select("source_id", "status", "error")


def lines(files: DataFrame) -> DataFrame:
    """(source_id, line_number, raw): lines end at LF or CR LF; numbers start at 1 and count blanks."""
    each = files.select("source_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw"))
    return each.select("source_id", (F.col("pos") + 1).cast("long").alias("line_number"), "raw")


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
