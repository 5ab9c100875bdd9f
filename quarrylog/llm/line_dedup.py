"""Line dedup over overlapping windows of three consecutive lines.

Every run of three lines of a document is a window; windows are compared by a
128-bit hash over the whole corpus. The occurrence with the smallest (doc_id,
line) stays. All lines that the later occurrences cover are removed; where a
later occurrence overlaps the first one in the same document, the lines of the
first stay. Only positions travel: a hot window costs one partial aggregate per
task, and the join back may split it.

Defined results: lines are separated by line feeds; windows of blank lines only
don't count; documents of fewer than three lines, empty or null texts are left
as they are (null text: no line); rows with a null doc_id are left whole and
not compared; rows that repeat a doc_id count as one document, so a window that
stands at one line of several of them is one occurrence and stays; an empty
table gives an empty result; other columns of any type pass, but for ones named
n_lines and n_removed, which the result's own replace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, free_name, materialize, others, table

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h1, h2) of every window that isn't blank."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    full = lines.where(F.size("l") >= WINDOW)

    def hashed(i):
        a, b, c = (F.get("l", i + k) for k in range(WINDOW))
        blank = F.concat(a, b, c).rlike(r"^\s*$")
        return F.struct(i.alias("line"), F.when(~blank, F.xxhash64(a, b, c)).alias("h1"), F.xxhash64(c, a, b).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), hashed)
    return full.select("doc_id", F.inline(each)).where("h1 IS NOT NULL")


def covered(all_windows: DataFrame) -> DataFrame:
    """(doc_id, spans): the line ranges [a, b) that later occurrences cover, per document."""
    first = all_windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "first")  # read from a table, so that the join may split a window that stands everywhere
    same = F.col("doc_id") == F.col("first.doc_id")
    start = F.when(same, F.greatest("line", F.col("first.line") + WINDOW)).otherwise(F.col("line"))
    later = (
        all_windows.join(first, ["h1", "h2"])
        .where(F.struct("doc_id", "line") > F.col("first"))
        .select("doc_id", F.struct(start.alias("a"), (F.col("line") + WINDOW).alias("b")).alias("span"))
    )
    return later.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def _cut(tag: str) -> Callable[[pd.DataFrame], Iterator[Made]]:
    def cut(batch: pd.DataFrame) -> Iterator[Made]:
        texts, counts, removed = [], [], []
        for text, spans in zip(batch["text"], batch[tag], strict=True):
            lines = [] if text is None else text.split("\n")
            gone = set()
            for span in spans if spans is not None else ():
                gone.update(range(span["a"], min(span["b"], len(lines))))
            kept = [line for i, line in enumerate(lines) if i not in gone] if gone else lines
            texts.append(text if not gone else "\n".join(kept))
            counts.append(len(lines))
            removed.append(len(gone))
        yield range(len(texts)), {"text": texts, "n_lines": counts, "n_removed": removed}

    return cut


def line_dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the text cut, and n_lines and n_removed."""
    rest, tag = others(docs, "text", "n_lines", "n_removed"), free_name("spans", docs)
    spans = covered(materialize(windows(docs.select("doc_id", "text")), "windows")).withColumnRenamed("spans", tag)
    # Rows without a doc_id don't meet in one task of the join.
    joined = docs.where("doc_id IS NOT NULL").join(spans, "doc_id", "left").select(*rest, "text", tag)
    without = docs.where("doc_id IS NULL").select(*rest, "text", F.lit(None).cast(spans.schema[tag].dataType).alias(tag))
    return beside(joined.union(without), lambda: _cut(tag), ["text", tag], "text string, n_lines long, n_removed long", keeps=rest)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE doc_id IS NOT NULL AND len(ls) >= 3)
  WHERE NOT regexp_matches(ls[i + 1] || ls[i + 2] || ls[i + 3], '^\s*$')
), f AS (
  SELECT doc_id, i, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi
  FROM w WINDOW o AS (PARTITION BY win ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(i, fi + 3) ELSE i END, i + 3)) AS line
  FROM f WHERE doc_id > fd OR (doc_id = fd AND i > fi)
), lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS s FROM l
), kept AS (
  SELECT doc_id, string_agg(s, chr(10) ORDER BY line) FILTER (WHERE g.line IS NULL) AS text,
         count(*) AS n_lines, count(g.line) AS n_removed
  FROM lines LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""
