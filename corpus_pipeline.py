"""Corpus pipeline: five stages from raw documents to packed token windows.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``docs`` has the columns of documents. The caller writes every stage's
result as Parquet and reads it again.

Defined results: an empty table passes every stage as an empty table; null and
empty texts have no language and go in the first stage; rows without a doc_id
are kept by the second and third stage, as they can't be told apart; of rows that
share a doc_id the third stage keeps one, that of the least text; other columns
than those of documents are dropped. What ties do is told in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylog.llm import language_id, line_dedup, mixing, ngram_join, packing
from quarrylog.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with some certainty, go; lang becomes the predicted one."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    # The prediction travels beside the row itself, so that rows without a doc_id keep theirs.
    rows = docs.select(*COLUMNS).withColumn("body", F.col("text"))
    named = language_id.predict(rows.select("doc_id", F.col("body"), "source", "n_chars", "text"), model)
    kept = named.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", F.col("body").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; so do documents that are left without any line."""
    cut = line_dedup.line_dedup(docs.select(*COLUMNS)).where("n_removed < n_lines OR n_removed = 0")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, and of rows that share a doc_id one."""
    docs = docs.select(*COLUMNS)
    groups = ngram_join.jaccard_join(docs.select("doc_id", "text"))
    gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # Few rows share a doc_id: only these are ordered.
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    order = Window.partitionBy("doc_id").orderBy(*COLUMNS[1:])
    one = left.join(repeated, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(one.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities towards the target shares."""
    return mixing.sample(docs.select(*COLUMNS), mixing.TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mixture),
    ("pack_sequences", packed),
]

#: Language identification can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
