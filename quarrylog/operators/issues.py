"""The issue pipeline: error groups to fingerprints, clusters and ranked issues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fingerprint as fp
from ..functions.patterns import staged
from ..functions.severity import SEVERITIES, severity_rank
from . import clusters

HIGH_CONFIDENCE = 0.7
# Issue titles by category; {s} is the first service and a space, if there is one.
TITLES = {
    "Connection": "{s}Connection Failure", "Timeout": "{s}Timeout", "Out of Memory": "Out of Memory", "Deadlock": "Deadlock Detected", "Permission": "Permission / Access Denied",
    "Not Found": "Resource Not Found", "Authentication": "Authentication Failure", "Authorization": "Authorization / Access Denied", "Failure": "{s}Operation Failure",
    "Processing Error": "Processing Error", "Crash": "Application Crash", "Retry": "Transient Error (Retrying)", "Data Integrity": "Data Integrity Error",
    "Disk": "Disk / Storage Error", "Rate Limit": "Rate Limiting",
}

Embedder = Callable[[DataFrame], DataFrame]


def hashed_embedder(dims: int = 256) -> Embedder:
    """Unit vectors of hashed character trigrams: (text) -> (text, embedding). Deterministic and local."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw, v = f"  {text.lower()} ".encode(), np.zeros(dims)
                for k in range(len(raw) - 2):
                    v[zlib.crc32(raw[k : k + 3]) % dims] += 1.0
                rows.append((v / (np.linalg.norm(v) or 1.0)).tolist())
            yield pd.DataFrame({"text": batch["text"], "embedding": rows})

    return lambda texts: texts.select("text").distinct().mapInPandas(run, "text string, embedding array<double>")


def fingerprinted(groups: DataFrame) -> DataFrame:
    clean = staged(groups, clean_message=fp.clean_message(F.col("message")))
    return staged(clean, fingerprint=F.lower("clean_message"), services=fp.services(F.col("message")), category=fp.category(F.col("message")))


def _ordered(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(column).alias("x")))), lambda s: s["x"])


def fingerprints(groups: DataFrame) -> DataFrame:
    """Error groups of one fingerprint; category and clean message are the first group's, services the union in order."""
    marked = fingerprinted(groups).withColumn("ord", F.struct(-F.col("occurrences"), F.col("first_line")))
    agg = marked.groupBy("source_id", "fingerprint").agg(
        F.min("ord").alias("ord"), F.array_distinct(F.flatten(_ordered("services"))).alias("services"),
        F.min_by(F.struct("category", "clean_message"), "ord").alias("f"), F.count("*").alias("variants"), F.sum("occurrences").alias("occurrences"),
    )
    return agg.select("source_id", "fingerprint", "ord", "services", "f.category", "f.clean_message", "variants", "occurrences")


def title(category: Column, services: Column) -> Column:
    first = F.when(F.size(services) > 0, F.concat(F.get(services, F.lit(0)), F.lit(" "))).otherwise("")
    out = F.concat(category, F.lit(" Error"))
    for name, shape in TITLES.items():
        text = F.concat(first, F.lit(shape.removeprefix("{s}"))) if shape.startswith("{s}") else F.lit(shape)
        out = F.when(category == name, text).otherwise(out)
    out = F.when((category == "Timeout") & (F.size(services) == 0), "Timeout Error").otherwise(out)
    return F.when(F.size(services) > 1, F.concat(out, F.lit(" ["), F.array_join(services, ", "), F.lit("]"))).otherwise(out)


def assign_clusters(prints: DataFrame, embedder: Embedder | None, threshold: float = clusters.ISSUE_THRESHOLD) -> DataFrame:
    """(source_id, fingerprint, cluster, confidence); without an embedder every fingerprint is a cluster."""
    if embedder is None:
        return prints.select("source_id", "fingerprint", F.col("fingerprint").alias("cluster"), F.lit(1.0).alias("confidence"))
    vectors = embedder(prints.select(F.col("clean_message").alias("text")))
    items = prints.join(vectors, prints["clean_message"] == vectors["text"]).select("source_id", "fingerprint", F.concat_ws("\x00", "source_id", "fingerprint").alias("id"), "embedding")
    items = clusters.checkpointed(items)
    named = clusters.cluster(items, threshold, ("source_id",)).join(items, "id").select("source_id", "fingerprint", "cluster", "size", "id", "embedding")
    mean = clusters.mean_similarity(named)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("mean", F.lit(1.0))))
    return named.join(mean, "cluster", "left").select("source_id", "fingerprint", "cluster", confidence.alias("confidence"))


def issues(groups: DataFrame, embedder: Embedder | None = None, compat_confidence_zero: bool = False) -> DataFrame:
    """Ranked issues per source. ``compat_confidence_zero`` sets the confidence of several fingerprints to 0."""
    marked = fingerprinted(groups).withColumn("ord", F.struct(-F.col("occurrences"), F.col("first_line")))
    member = fingerprints(groups)
    home = assign_clusters(member, embedder)
    rows = marked.join(home, ["source_id", "fingerprint"])
    by_print = member.select("source_id", "fingerprint", "services", "category", F.col("ord").alias("print_ord")).join(home, ["source_id", "fingerprint"])
    by_cluster = by_print.withColumn("ord", F.col("print_ord")).groupBy("source_id", "cluster").agg(
        F.array_distinct(F.flatten(_ordered("services"))).alias("affected_services"), F.min_by("fingerprint", "ord").alias("fingerprint"), F.count("*").alias("size"),
        F.coalesce(F.min_by(F.when(F.col("category") != fp.GENERAL, F.col("category")), F.when(F.col("category") != fp.GENERAL, F.col("ord"))), F.lit(fp.GENERAL)).alias("category"),
        F.max("confidence").alias("confidence"),
    )
    rank = severity_rank(F.col("severity"))
    totals = rows.groupBy("source_id", "cluster").agg(
        F.min_by("message", "ord").alias("message"), F.sum("occurrences").alias("occurrences"), F.min("first_occurrence").alias("first_seen"), F.max("last_occurrence").alias("last_seen"),
        F.min(rank).alias("rank"), F.count("*").alias("variants"), F.min_by(F.struct("message", "level", "severity", "occurrences", "first_line"), "ord").alias("representative"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample_raw"))), lambda s: s["sample_raw"]).alias("raw_samples"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("message", "level", "severity", "occurrences").alias("e")))), lambda s: s["e"]).alias("related_errors"),
    )
    both = totals.join(by_cluster, ["source_id", "cluster"])
    confidence = F.when(F.col("size") > 1, 0.0).otherwise(F.col("confidence")) if compat_confidence_zero else F.col("confidence")
    more = F.concat(F.lit(" ("), F.col("variants"), F.lit(" related error variants, "), F.format_number("occurrences", 0), F.lit(" total occurrences)"))
    return both.select(
        "source_id", title(F.col("category"), F.col("affected_services")).alias("title"), "category", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1).alias("severity"),
        F.when(F.col("variants") > 1, F.concat("message", more)).otherwise(F.col("message")).alias("message"), "occurrences", "first_seen", "last_seen", "affected_services",
        "related_errors", "raw_samples", "representative", confidence.alias("confidence"), (confidence >= HIGH_CONFIDENCE).alias("is_high_confidence"), "fingerprint", F.col("rank").alias("severity_rank"), F.col("size").alias("fingerprints"),
        F.lit(embedder is not None).alias("embedding_available"),
    )


def ranked(found: DataFrame) -> DataFrame:
    """Issues with their ``position`` in their source: the worst severity first, then by occurrences, then by first appearance."""
    order = Window.partitionBy("source_id").orderBy("severity_rank", F.desc("occurrences"), F.col("representative.first_line"))
    return found.withColumn("position", F.row_number().over(order).cast("long"))


class CachedEmbedder:
    """An embedder that keeps its vectors as Parquet by text, so that a text is embedded once; ``clear`` forgets them."""

    def __init__(self, embedder: Embedder, path: str) -> None:
        self.embedder, self.path, self.parts = embedder, path, []

    def __call__(self, texts: DataFrame) -> DataFrame:
        wanted, spark = texts.select("text").distinct(), texts.sparkSession
        known = spark.read.parquet(*self.parts) if self.parts else None
        missing = wanted if known is None else wanted.join(known.select("text"), "text", "left_anti")
        part = f"{self.path}/part-{len(self.parts)}"
        self.embedder(missing).select("text", "embedding").write.mode("overwrite").parquet(part)
        self.parts.append(part)
        return spark.read.parquet(*self.parts).join(wanted, "text", "left_semi")

    def clear(self) -> None:
        self.parts.clear()


def embedder_or_none(make: Callable[[], Embedder]) -> Embedder | None:
    """The embedder that ``make`` loads, or nothing if it can't: issues then go by fingerprint only."""
    try:
        return make()
    except Exception:  # a model may fail to load in any way  # noqa: BLE001
        return None


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embedder:
    """An embedder by a model: ``load`` runs once in a Python worker and returns texts -> vectors, which are made unit vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = load()
        for batch in batches:
            rows = np.asarray(model(batch["text"].tolist()), dtype=float).reshape(len(batch), -1)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.DataFrame({"text": batch["text"], "embedding": list(rows / np.where(norms > 0, norms, 1.0))})

    return lambda texts: texts.select("text").distinct().mapInPandas(run, "text string, embedding array<double>")
