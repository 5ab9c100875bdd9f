"""Exact dedup as a tree merge of sorted digest runs.

Each input partition starts as one run: its distinct keys in order, with the
smallest identifier and a count. In round k the runs of ``fan_in`` neighbours of
round k - 1 exchange their entries and are merged, multiway, into one, keeping
the smallest identifier, until one run is left: ceil(log(partitions)) rounds.
An entry moves only as a fixed-size record, equal ones are merged before as well
as after each exchange, and a run is spread over the partitions by digest, so a
group of copies of any size costs one record per run and no task gathers it or a
run. A key is the SHA-256 of the text, verified at every level by the byte
length and an independent 64-bit hash of the text. The rows then look up their
key; both sides of that join are tables, so that a key of very many rows splits.

Defined results: null text counts as empty; white space runs become one space
but are not trimmed; among rows of one text the smallest doc_id stays, a null
doc_id only if there is no other; of repeated rows with that same doc_id one
stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

FAN_IN = 4
KEY = ("digest", "check", "bytes")


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One fixed-size record per row: identifier, digest, verified length, run and a row tag."""
    clean = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    return clean.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("tag"),
    )


def rounds(runs: int, fan_in: int = FAN_IN) -> int:
    """How often ``runs`` runs are merged until one is left; a single run is merged with itself once."""
    n = 1
    while fan_in**n < runs:
        n += 1
    return n


def tree_merge(entries: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the sorted runs of ``entries`` into one: the key, ``head`` and ``group_size``.

    ``head`` is the smallest (doc_id, tag) of the key, a null doc_id last. Taking
    the least struct makes Spark merge runs sorted by key on both sides of the exchange.
    """
    last = entries.agg(F.max("run")).first()[0]
    head = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tag").alias("head")
    merged = entries.select(*KEY, "run", head, F.lit(1).cast("long").alias("n"))
    for _ in range(rounds((last or 0) + 1, fan_in)):
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy(*KEY, "run").agg(F.min("head").alias("head"), F.sum("n").alias("n"))
    return merged.select(*KEY, "head", F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Every row with its survivor: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = materialize(digests(docs, id_col, text_col), "digests")
    merged = materialize(tree_merge(entries, fan_in), "merged")
    return entries.join(merged, list(KEY)).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("head.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
