"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic, weighted by tokens
(runs of other characters than ASCII white space). The cells' weights are raked
in turn to the target share of every source, language and topic, until all
margins are met to ``TOLERANCE`` or ``rounds`` are over; a document of a cell is
then kept with probability raked weight / actual weight, scaled so that the
largest is 1, which makes the expected token shares those of the raked table.
The draw is a hash of doc_id, so it is the same on every run. The cell table is
raked on the driver if it has at most ``MOST_CELLS`` cells, as counted, or else by
joins and sums; both give the same weights.

A margin's target names the share of each of its values, as a dict or a table
(value, share); without one, its shares are the actual ones to the power
``temper``, normalised. The topic is told from the text's make-up: empty,
figures, symbols, list, long or prose.

Defined results: a value that a target doesn't name, or names with a share of 0,
gets weight 0, so its documents go; shares are normalised over the values that
are left, so a value without documents takes nothing; without any cell left all
probabilities are 0. Null source or lang is the value "(none)"; null text counts
as empty; documents of a cell without tokens have no weight to rake and are kept;
rows that repeat a doc_id share one draw; a null doc_id is drawn as the empty
string; an empty table gives an empty result; other columns of any name pass
through ``sample`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, table

MARGINS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, MOST_CELLS = 30, 1e-12, 100_000
NONE = "(none)"
#: Powers of the actual shares for margins without a target: sources are flattened towards each other, topics less.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: The targets of the registered query: half English, the rest in even parts; sources and topics are tempered.
TARGETS = {"lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}}

Target = dict[str, float] | DataFrame


def facts(docs: DataFrame) -> dict[str, Column]:
    """Columns of the margins and the token count."""
    text = F.coalesce("text", F.lit(""))
    n_chars, n_lines = F.length(text), F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    n_tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    digits = n_chars - F.length(F.translate(text, "0123456789", ""))
    symbols = n_chars - F.length(F.translate(text, "#$%&*+<=>@^_|~{}[]", ""))
    topic = (
        F.when(n_tokens == 0, "empty").when(digits * 25 > n_chars, "figures").when(symbols * 20 > n_chars, "symbols")
        .when(n_tokens < n_lines * 12, "list").when(n_tokens >= 1000, "long").otherwise("prose")
    )
    none = F.lit(NONE)
    return {"source": F.coalesce("source", none), "lang": F.coalesce("lang", none), "topic": topic, "n_tokens": n_tokens.cast("long")}


def goals(cells: DataFrame, targets: dict[str, Target], temper: dict[str, float]) -> dict[str, DataFrame]:
    """Per margin a table (margin, share) of the values with a share above 0."""
    spark, out = cells.sparkSession, {}
    for m in MARGINS:
        target = targets.get(m)
        if target is None:
            found = cells.where("tokens > 0").groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), temper[m]).alias("share"))
        elif isinstance(target, dict):
            found = spark.createDataFrame(list(target.items()) or [("", 0.0)], f"{m} string, share double")
        else:
            found = target.select(m, F.col("share").cast("double").alias("share"))
        out[m] = found.where("share > 0")
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, most_local: int = MOST_CELLS) -> DataFrame:
    """``cells`` (margins, tokens > 0) that all targets name, with their raked weight; the weights add up to 1."""
    left = cells
    for m in MARGINS:
        left = left.join(targets[m].select(m, F.col("share").alias(f"share_{m}")), m)
    left = materialize(left, "cells")
    raked = _rake_here(left, rounds) if left.limit(most_local + 1).count() <= most_local else _rake_there(left, rounds)
    return raked.select(*cells.columns, "weight")


def _rake_here(cells: DataFrame, rounds: int) -> DataFrame:
    rows = cells.collect()  # at most MOST_CELLS
    schema = cells.schema.add("weight", "double")
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    weight = np.array([float(r["tokens"]) for r in rows])
    codes, shares = {}, {}
    for m in MARGINS:
        values, codes[m] = np.unique([str(r[m]) for r in rows], return_inverse=True)
        share = np.zeros(len(values))
        share[codes[m]] = [r[f"share_{m}"] for r in rows]
        shares[m] = share / share.sum()
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            now = np.bincount(codes[m], weights=weight)
            factor = shares[m] / now
            worst = max(worst, float(np.abs(factor - 1).max()))
            weight = weight * factor[codes[m]]
        if worst < TOLERANCE:
            break
    return cells.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight, strict=True)], schema)


def _rake_there(cells: DataFrame, rounds: int) -> DataFrame:
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        one = materialize(cells.select(m, f"share_{m}").distinct(), "shares")
        whole = one.agg(F.sum(f"share_{m}")).first()[0] or 1.0
        fitted = fitted.withColumn(f"share_{m}", F.col(f"share_{m}") / F.lit(float(whole)))
    fitted = materialize(fitted, "raked")
    for _ in range(rounds):
        before, errors = fitted, []
        for m in MARGINS:
            now = fitted.groupBy(m).agg(F.sum("weight").alias("now"))
            fitted = fitted.join(now, m).withColumn("factor", F.col(f"share_{m}") / F.col("now"))
            fitted = fitted.withColumn("weight", F.col("weight") * F.col("factor")).withColumnRenamed("factor", f"factor_{m}").drop("now")
            errors.append(F.abs(F.col(f"factor_{m}") - 1))
        stepped = materialize(fitted.withColumn("error", F.greatest(*errors)).drop(*[f"factor_{m}" for m in MARGINS]), "raked")
        discard(before)
        worst = stepped.agg(F.max("error")).first()[0]
        fitted = stepped.drop("error")
        fitted._stored_at = stepped._stored_at
        if worst is None or worst < TOLERANCE:
            break
    return fitted


def probabilities(docs: DataFrame, targets: dict[str, Target] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability) of every cell with tokens."""
    return fitted_cells(docs.select(*[c.alias(k) for k, c in facts(docs).items()]), targets, temper, rounds)


def fitted_cells(keyed: DataFrame, targets: dict[str, Target] | None, temper: dict[str, float], rounds: int) -> DataFrame:
    """``probabilities`` of rows that have their margins and n_tokens."""
    cells = materialize(keyed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    raked = rake(cells, goals(cells, targets or {}, temper), rounds).select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("ratio"))
    raked = materialize(raked, "ratios")
    top = raked.agg(F.max("ratio")).first()[0] or 1.0
    chance = F.round(F.coalesce(F.col("ratio"), F.lit(0.0)) / F.lit(float(top)), 6)
    out = materialize(cells.select(*MARGINS).join(raked, list(MARGINS), "left").select(*MARGINS, chance.alias("probability")), "chances")
    return F.broadcast(out) if out.limit(MOST_CELLS + 1).count() <= MOST_CELLS else out


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) that only depends on doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def decide(docs: DataFrame, targets: dict[str, Target] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, margins, n_tokens, probability and kept of every document."""
    keyed = materialize(docs.select("doc_id", *[c.alias(k) for k, c in facts(docs).items()]), "facts")
    rated = keyed.join(fitted_cells(keyed, targets, temper, rounds), list(MARGINS), "left")
    p = F.coalesce("probability", F.lit(1.0))
    return rated.select("doc_id", *MARGINS, "n_tokens", p.alias("probability"), (draw() < p).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, Target] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """The documents that the draw keeps, with their own columns."""
    names, p = {m: free_name(f"_{m}", docs) for m in MARGINS}, free_name("_probability", docs)
    cell = probabilities(docs, targets, temper, rounds).withColumnsRenamed({**names, "probability": p})
    made = facts(docs)
    keyed = docs.withColumns({names[m]: made[m] for m in MARGINS})
    kept = keyed.join(cell, list(names.values()), "left").where(draw() < F.coalesce(F.col(p), F.lit(1.0)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), TARGETS)


def oracle_sql(targets: dict[str, dict[str, float]] = TARGETS, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> str:
    named = []
    for m in MARGINS:
        if m in targets:
            values = ", ".join(f"('{v}', {share!r}::DOUBLE)" for v, share in targets[m].items())
            named.append(f"w_{m} AS (SELECT * FROM (VALUES {values}) v({m}, share) WHERE share > 0)")
        else:
            named.append(f"w_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {temper[m]}) AS share FROM cells GROUP BY {m})")
    joins = " ".join(f"JOIN w_{m} USING ({m})" for m in MARGINS)
    named.append(f"left_over AS (SELECT c.*, {', '.join(f'w_{m}.share AS s_{m}' for m in MARGINS)} FROM cells c {joins})")
    named += [f"t_{m} AS MATERIALIZED (SELECT {m}, any_value(s_{m}) / sum(any_value(s_{m})) OVER () AS share FROM left_over GROUP BY {m})" for m in MARGINS]
    steps, last = [], "left_over"
    for r in range(rounds):
        for m in MARGINS:
            name = f"r{r}_{m}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, weight * share / sum(weight) OVER (PARTITION BY c.{m}) AS weight"
                f" FROM {last} c JOIN t_{m} ON c.{m} = t_{m}.{m})"
            )
            last = name
    margins = ", ".join(named)
    return rf"""
WITH raw AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t,
         length(coalesce(text, '')) AS n, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), keyed AS (
  SELECT doc_id, source, lang, n_tokens, CASE
    WHEN n_tokens = 0 THEN 'empty'
    WHEN (n - length(translate(t, '0123456789', ''))) * 25 > n THEN 'figures'
    WHEN (n - length(translate(t, '#$%&*+<=>@^_|~{{}}[]', ''))) * 20 > n THEN 'symbols'
    WHEN n_tokens < n_lines * 12 THEN 'list' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic
  FROM raw
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM keyed
  GROUP BY ALL HAVING sum(n_tokens) > 0
), {margins}, {", ".join(steps)}, chances AS (
  SELECT c.source, c.lang, c.topic, round(coalesce((r.weight / r.tokens) / max(r.weight / r.tokens) OVER (), 0), 6) AS probability
  FROM cells c LEFT JOIN {last} r USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, coalesce(probability, 1.0) AS probability,
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(probability, 1.0) AS kept
FROM keyed LEFT JOIN chances USING (source, lang, topic)
"""


ORACLE_SQL = oracle_sql()
