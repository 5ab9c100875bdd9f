"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fingerprint as fp
from ..functions import parsing
from ..functions import terminal_rules as tr
from ..functions.patterns import extract
from ..functions.severity import SEVERITY_RULES, classify_severity
from ..operators import clusters, issues, logs, report, terminal
from ..sources import logs as source
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VECTOR_THRESHOLD = 0.4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {lit(('(?i)' if ignore_case else '') + pattern)})"


def group(text: str, pattern: str, n: int = 0, ignore_case: bool = False) -> str:
    return f"nullif(regexp_extract({text}, {lit(('(?i)' if ignore_case else '') + pattern)}, {n}), '')"


def swap(text: str, pattern: str, by: str, ignore_case: bool = False, all_of_them: bool = True) -> str:
    return f"regexp_replace({text}, {lit(('(?i)' if ignore_case else '') + pattern)}, {lit(by)}{', ' + lit('g') if all_of_them else ''})"


def trimmed(text: str) -> str:
    return swap(text, r"^\s+|\s+$", "")


def severity_sql(hay: str, level: str) -> str:
    rules = " ".join(f"WHEN contains(lower({hay}), {lit(r.pattern.lower())}) THEN {lit(r.severity)}" for r in SEVERITY_RULES)
    return f"CASE {rules} WHEN {level} = 'WARN' THEN 'Medium' WHEN {level} = 'ERROR' THEN 'High' ELSE 'Low' END"


def collapse_sql(text: str) -> str:
    text = swap(text, r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<uuid>", True)
    text = swap(text, r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>")
    text = swap(swap(text, r"\b0x[0-9a-f]+\b", "<hex>", True), parsing._STAMP, "<ts>")
    return swap(text, r"\d+", "<n>")


def clean_sql(text: str) -> str:
    for pattern, by, ignore_case in fp.REPLACEMENTS:
        text = swap(text, pattern, by.replace("$1", r"\1"), ignore_case)
    return trimmed(swap(text, r"\s+", " "))


# Parsed lines of the application log: structured text lines, and lines without a level.
_TEXT = matches("raw", parsing.TEXT_PATTERN)
_WORD = group("raw", parsing.TEXT_PATTERN, 2)
ENTRIES = f"""{views.sql("app_log")}, entries AS (
  SELECT source_id, line_number, raw,
    CASE WHEN {_TEXT} THEN CASE {_WORD} WHEN 'WARNING' THEN 'WARN' WHEN 'CRITICAL' THEN 'FATAL' ELSE {_WORD} END ELSE 'UNKNOWN' END AS level,
    CASE WHEN {_TEXT} THEN {group("raw", parsing.TEXT_PATTERN, 1)} ELSE {group("raw", parsing.TIMESTAMP_PATTERN)} END AS timestamp,
    CASE WHEN {_TEXT} THEN {group("raw", parsing.TEXT_PATTERN, 3)} ELSE {trimmed("raw")} END AS message,
    CASE WHEN {_TEXT} THEN {collapse_sql(group("raw", parsing.TEXT_PATTERN, 3))} ELSE lower({trimmed("raw")}) END AS normalized_message
  FROM app_log)"""
GROUPS = f"""{ENTRIES}, groups AS (
  SELECT source_id, level, arg_min(message, line_number) AS message, arg_min(normalized_message, line_number) AS normalized_message,
    count(*) AS occurrences, min(timestamp) AS first_occurrence, max(timestamp) AS last_occurrence, min(line_number) AS first_line, trim(arg_min(raw, line_number)) AS sample_raw
  FROM entries WHERE level IN ('ERROR', 'CRITICAL', 'FATAL') GROUP BY source_id, level, lower(normalized_message))"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(views.lines(spark, sf_dir, "app_log"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.error_groups(_entries(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return source.lines(source.pasted(docs, "text", "doc_id"))


_DOC_LINES = r"doc_lines AS (SELECT doc_id AS source_id, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS raw FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM documents))"


@query(f"WITH {_DOC_LINES} SELECT source_id, line_number, raw FROM doc_lines")
def s13_line_split(spark, sf_dir):
    return _documents(spark, sf_dir)


@query(rf"WITH {_DOC_LINES} SELECT source_id, count(*) FILTER (regexp_matches(raw, '\S')) AS total_lines, count(*) FILTER (NOT regexp_matches(raw, '\S')) AS blank_lines FROM doc_lines GROUP BY source_id")
def s15_blank_counts(spark, sf_dir):
    return logs.line_counters(_documents(spark, sf_dir))


@query(
    f"""WITH {views.sql("mixed_log")}, f AS (SELECT source_id, line_number, CASE WHEN raw LIKE '{{%' THEN 'json' WHEN {matches("raw", parsing.SYSLOG_PATTERN)} THEN 'syslog' WHEN {_TEXT} THEN 'text' END AS format FROM mixed_log),
    n AS (SELECT source_id, format, count(*) AS n, min(line_number) AS seen FROM f WHERE format IS NOT NULL AND line_number <= 50 GROUP BY ALL),
    b AS (SELECT source_id, format FROM n QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, seen) = 1)
    SELECT DISTINCT m.source_id, coalesce(b.format, 'unknown') AS detected_format FROM mixed_log m LEFT JOIN b USING (source_id)"""
)
def p1_detect_format(spark, sf_dir):
    return logs.detect_format(views.lines(spark, sf_dir, "mixed_log"))


_STATUS = "try_cast(" + group("raw", parsing.ACCESS_PATTERN, 5) + " AS INT)"


@query(
    f"""WITH {views.sql("access_log")} SELECT source_id, line_number, {group("raw", parsing.ACCESS_PATTERN, 3)} || ' ' || {group("raw", parsing.ACCESS_PATTERN, 4)} || ' — ' || {group("raw", parsing.ACCESS_PATTERN, 5)} AS message,
    CASE WHEN {_STATUS} >= 500 THEN 'ERROR' WHEN {_STATUS} >= 400 THEN 'WARN' ELSE 'INFO' END AS level, 'nginx' AS format FROM access_log"""
)
def p4_access_lines(spark, sf_dir):
    return logs.parse_lines(views.lines(spark, sf_dir, "access_log")).select("source_id", "line_number", "message", "level", "format")


@query(f"WITH {views.sql('app_log')} SELECT source_id, line_number, {group('raw', parsing.LEVEL_PATTERN)} AS word, {group('raw', parsing.TIMESTAMP_PATTERN)} AS timestamp FROM app_log")
def p9_level_and_time(spark, sf_dir):
    rows = views.lines(spark, sf_dir, "app_log")
    return rows.select("source_id", "line_number", extract(F.col("raw"), parsing.LEVEL_PATTERN).alias("word"), extract(F.col("raw"), parsing.TIMESTAMP_PATTERN).alias("timestamp"))


def _local_sql() -> str:
    text = f"replace(raw, {group('raw', parsing.TIMESTAMP_PATTERN)}, '')"  # the view's lines hold their timestamp once
    text = swap(text, parsing.LEVEL_PATTERN, "", all_of_them=False)
    text = swap(swap(text, r"^\s*[\[\(][^\]\)]*[\]\)]\s*", ""), r"^[\s:\-|]+", "")
    return f"CASE WHEN {matches('raw', parsing.LEVEL_PATTERN)} THEN {trimmed(swap(text, r'\b\d{3,}\b', '#'))} ELSE {trimmed('raw')} END"


@query(f"WITH {views.sql('app_log')} SELECT source_id, line_number, {_local_sql()} AS message FROM app_log")
def p12_normalize_local(spark, sf_dir):
    return views.lines(spark, sf_dir, "app_log").select("source_id", "line_number", parsing.parse_unstructured(F.col("raw"))["message"].alias("message"))


@query(f"WITH {ENTRIES} SELECT source_id, line_number, {severity_sql("level || ' ' || message", 'level')} AS severity FROM entries")
def p15_severity(spark, sf_dir):
    return _entries(spark, sf_dir).select("source_id", "line_number", classify_severity(F.col("level"), F.col("message")).alias("severity"))


@query(f"WITH {ENTRIES} SELECT source_id, level, count(*) AS n FROM entries GROUP BY ALL")
def a1_level_counts(spark, sf_dir):
    return logs.level_counts(_entries(spark, sf_dir))


@query(
    f"WITH {ENTRIES} SELECT source_id, count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL')) AS error_count, count(*) FILTER (level IN ('CRITICAL', 'FATAL')) AS critical_count, count(*) FILTER (level = 'WARN') AS warning_count FROM entries GROUP BY ALL"
)
def a3_headline(spark, sf_dir):
    return logs.headline(_entries(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT *, {severity_sql("level || ' ' || message", 'level')} AS severity FROM groups")
def a4_error_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(
    f"""WITH {ENTRIES} SELECT source_id, strftime(date_trunc('hour', timestamp::TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS start, count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL')) AS error_count,
    count(*) FILTER (level = 'WARN') AS warn_count, count(*) FILTER (level NOT IN ('ERROR', 'CRITICAL', 'FATAL', 'WARN')) AS info_count, count(*) AS total_count FROM entries GROUP BY ALL"""
)
def a9_hour_buckets(spark, sf_dir):
    return logs.time_buckets(_entries(spark, sf_dir))


@query(
    f"""WITH {GROUPS} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY occurrences DESC, first_line) AS rank, message, normalized_message, occurrences AS count,
    floor(occurrences / sum(occurrences) OVER (PARTITION BY source_id) * 1000 + 0.5) / 10 AS percentage FROM groups"""
)
def a12_error_frequency(spark, sf_dir):
    return logs.error_frequency(_groups(spark, sf_dir))


_MIXED = f"""{views.sql("mixed_log")}, e AS (SELECT *, CASE WHEN raw LIKE '{{%' THEN 'json' WHEN {matches("raw", parsing.SYSLOG_PATTERN)} THEN 'syslog' WHEN {_TEXT} THEN 'text' END AS format FROM mixed_log),
  p AS (SELECT *, CASE format WHEN 'json' THEN upper(raw::JSON ->> 'level') WHEN 'syslog' THEN 'INFO' WHEN 'text' THEN CASE {_WORD} WHEN 'WARNING' THEN 'WARN' WHEN 'CRITICAL' THEN 'FATAL' ELSE {_WORD} END ELSE 'UNKNOWN' END AS level,
    lower(CASE format WHEN 'json' THEN {collapse_sql("(raw::JSON ->> 'msg')")} WHEN 'text' THEN {collapse_sql(group("raw", parsing.TEXT_PATTERN, 3))} ELSE raw END) AS body FROM (SELECT * FROM e WHERE raw <> '')),
  n AS (SELECT source_id, format, count(*) AS n, min(line_number) AS seen FROM e WHERE format IS NOT NULL AND line_number <= 50 GROUP BY ALL),
  f AS (SELECT source_id, format FROM n QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, seen) = 1)"""


@query(
    f"""WITH {_MIXED} SELECT m.source_id, count(*) FILTER (m.raw <> '') AS total_lines, count(*) FILTER (m.raw = '') AS blank_lines,
    count(*) FILTER (p.level IN ('ERROR', 'CRITICAL', 'FATAL')) AS error_count, count(*) FILTER (p.level IN ('CRITICAL', 'FATAL')) AS critical_count, count(*) FILTER (p.level = 'WARN') AS warning_count,
    count(DISTINCT p.level || '::' || p.body) FILTER (p.level IN ('ERROR', 'CRITICAL', 'FATAL')) AS unique_error_count, coalesce(any_value(f.format), 'unknown') AS detected_format
    FROM mixed_log m LEFT JOIN p ON m.source_id = p.source_id AND m.line_number = p.line_number LEFT JOIN f ON m.source_id = f.source_id GROUP BY m.source_id"""
)
def a_summary(spark, sf_dir):
    return logs.summary(views.lines(spark, sf_dir, "mixed_log")).drop("processed_at")


@query(f"WITH {GROUPS} SELECT source_id, first_line, {clean_sql('message')} AS clean_message, lower({clean_sql('message')}) AS fingerprint FROM groups")
def f_fingerprint(spark, sf_dir):
    return issues.fingerprinted(_groups(spark, sf_dir)).select("source_id", "first_line", "clean_message", "fingerprint")


_SERVICES = " UNION ALL ".join(f"SELECT source_id, first_line, {lit(name)} AS service FROM groups WHERE {matches('message', pattern, True)}" for pattern, name in fp.SERVICES)


@query(f"WITH {GROUPS} {_SERVICES}")
def f13_services(spark, sf_dir):
    return _groups(spark, sf_dir).select("source_id", "first_line", F.explode(fp.services(F.col("message"))).alias("service"))


_CATEGORY = "CASE " + " ".join(f"WHEN {matches('message', p, True)} THEN {lit(n)}" for p, n in fp.CATEGORIES) + " ELSE 'General' END"


@query(f"WITH {GROUPS} SELECT source_id, first_line, {_CATEGORY} AS category FROM groups")
def f14_category(spark, sf_dir):
    return _groups(spark, sf_dir).select("source_id", "first_line", fp.category(F.col("message")).alias("category"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


_PAIRS = f"""pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS similarity
  FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {VECTOR_THRESHOLD})"""


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def c1_similar_pairs(spark, sf_dir):
    return clusters.similar_pairs(_vectors(spark, sf_dir), VECTOR_THRESHOLD, ("label",)).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE {_PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(id, far) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.far = l.a),
    named AS (SELECT id, min(far) AS cluster FROM reach GROUP BY id) SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM named"""
)
def c3_clusters(spark, sf_dir):
    return clusters.cluster(_vectors(spark, sf_dir), VECTOR_THRESHOLD, ("label",))


@query(
    """WITH flat AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS mean FROM flat GROUP BY ALL)
    SELECT label, pos::INT AS pos, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS value FROM m"""
)
def c5_centroids(spark, sf_dir):
    return clusters.centroids(_vectors(spark, sf_dir), "label").select("label", "pos", F.round("value", 6).alias("value"))


@query(f"WITH {GROUPS} SELECT source_id, lower({clean_sql('message')}) AS fingerprint, count(*) AS variants, sum(occurrences)::BIGINT AS occurrences FROM groups GROUP BY ALL")
def i1_fingerprint_dedup(spark, sf_dir):
    return issues.fingerprints(_groups(spark, sf_dir)).select("source_id", "fingerprint", "variants", "occurrences")


@query(
    f"""WITH {GROUPS}, p AS (SELECT *, lower({clean_sql("message")}) AS fingerprint, {_CATEGORY} AS category, {severity_sql("level || ' ' || message", "level")} AS severity FROM groups)
    SELECT source_id, fingerprint, arg_min(category, (-occurrences, first_line)) AS category, sum(occurrences)::BIGINT AS occurrences, min(first_occurrence) AS first_seen, max(last_occurrence) AS last_seen,
    CASE min(CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END) WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity FROM p GROUP BY source_id, fingerprint"""
)
def i_issues_by_fingerprint(spark, sf_dir):
    return issues.issues(_groups(spark, sf_dir)).select("source_id", "fingerprint", "category", "occurrences", "first_seen", "last_seen", "severity")


ISSUES = f"""{GROUPS}, p AS (SELECT *, lower({clean_sql("message")}) AS fingerprint, {_CATEGORY} AS category, {severity_sql("level || ' ' || message", "level")} AS severity,
    list_filter([{", ".join(f"CASE WHEN {matches('message', pattern, True)} THEN {lit(name)} END" for pattern, name in fp.SERVICES)}], lambda x: x IS NOT NULL) AS services FROM groups),
  i AS (SELECT source_id, fingerprint, sum(occurrences)::BIGINT AS occurrences, min(CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END) AS rank, count(*) AS variants,
    arg_min(first_line, (-occurrences, first_line)) AS first_line, arg_min(message, (-occurrences, first_line)) AS message, arg_min(level, (-occurrences, first_line)) AS level,
    arg_min(services, (-occurrences, first_line)) AS services, arg_min(trim(sample_raw), (-occurrences, first_line)) AS sample, arg_min(category, (-occurrences, first_line)) AS category FROM p GROUP BY source_id, fingerprint)"""


@query(f"WITH {ISSUES} SELECT source_id, fingerprint, row_number() OVER (PARTITION BY source_id ORDER BY rank, occurrences DESC, first_line) AS position FROM i")
def i17_issue_rank(spark, sf_dir):
    return issues.ranked(issues.issues(_groups(spark, sf_dir))).select("source_id", "fingerprint", "position")


@query(f"WITH {ISSUES} SELECT source_id, fingerprint, message, level, first_line, false AS embedding_available FROM i")
def i6_representative(spark, sf_dir):
    found = issues.issues(_groups(spark, sf_dir))
    return found.select("source_id", "fingerprint", "representative.message", "representative.level", "representative.first_line", "embedding_available")


@query(f"WITH {ISSUES} SELECT source_id, fingerprint, coalesce(nullif(array_to_string(services, ', '), ''), 'No service named') AS services, variants, sample FROM i")
def u11_issue_detail(spark, sf_dir):
    return report.issue_detail(issues.issues(_groups(spark, sf_dir)))


_FIRST = "CASE WHEN len(services) > 0 THEN services[1] || ' ' ELSE '' END"
_TITLE = (
    "CASE WHEN category = 'Timeout' AND len(services) = 0 THEN 'Timeout Error' "
    + " ".join(f"WHEN category = {lit(c)} THEN {(_FIRST + ' || ') if t.startswith('{s}') else ''}{lit(t.removeprefix('{s}'))}" for c, t in issues.TITLES.items())
    + " ELSE category || ' Error' END"
)


@query(f"WITH {ISSUES} SELECT source_id, fingerprint, {_TITLE} || CASE WHEN len(services) > 1 THEN ' [' || array_to_string(services, ', ') || ']' ELSE '' END AS title FROM i")
def i12_titles(spark, sf_dir):
    return issues.issues(_groups(spark, sf_dir)).select("source_id", "fingerprint", "title")


@query(f"WITH {ISSUES} SELECT g.source_id, g.error_groups, count(*) AS fingerprints, count(*) AS issues FROM (SELECT source_id, count(*) AS error_groups FROM groups GROUP BY ALL) g JOIN i USING (source_id) GROUP BY ALL")
def u7_funnel(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    return report.funnel(groups, issues.issues(groups))


@query(
    f"""WITH RECURSIVE {_PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(id, far) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.far = l.a),
    named AS (SELECT id, min(far) AS cluster FROM reach GROUP BY id) SELECT row_number() OVER (ORDER BY count(*) DESC, cluster) AS position, cluster, count(*) AS size FROM named GROUP BY cluster"""
)
def c4_cluster_order(spark, sf_dir):
    return clusters.positions(clusters.cluster(_vectors(spark, sf_dir), VECTOR_THRESHOLD, ("label",)))


@query()
def i_issues_embedded(spark, sf_dir):
    return issues.issues(_groups(spark, sf_dir), issues.hashed_embedder())


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminal.classify(views.lines(spark, sf_dir, "sessions"))


_RULE = "CASE WHEN NOT regexp_matches(raw, '\\S') THEN NULL " + " ".join(f"WHEN {matches('raw', r.pattern, r.ignore_case)} THEN {k}" for k, r in enumerate(tr.RULES)) + " END"
_FRAME = "(" + " OR ".join(matches("raw", p) for p in tr.STACK_PATTERNS) + ")"
_MORE = "(raw LIKE ' %' OR raw LIKE chr(9) || '%' OR as_it_was LIKE '|%' OR as_it_was LIKE '>%' OR " + " OR ".join(f"contains(raw, {lit(c)})" for c in tr.CONTINUATIONS) + ")"
_COMMAND = f"CASE WHEN {matches('raw', tr.PROMPT_PATTERN)} THEN nullif({trimmed(swap('raw', tr.PROMPT_PATTERN, ''))}, '') END"
LINES = f"""{views.sql("sessions")}, cleaned AS (SELECT source_id, line_number, raw AS as_it_was, {swap("raw", tr._ANSI, "")} AS raw FROM sessions),
  l AS (SELECT source_id, line_number, raw, as_it_was, {_RULE} AS rule, {_FRAME} AS frame, {matches("raw", tr.CODE_FRAME_PATTERN)} AS code, NOT regexp_matches(raw, '\\S') AS blank,
  {matches("raw", tr.PROMPT_PATTERN)} AS prompt, {_COMMAND} AS command, {_MORE} AS more FROM cleaned)"""


@query(f"WITH {LINES} SELECT source_id, command, count(*) AS occurrences, min(line_number) AS first_line FROM l WHERE command IS NOT NULL GROUP BY ALL")
def t2_commands(spark, sf_dir):
    return terminal.commands(_session(spark, sf_dir))


@query(f"WITH {LINES} SELECT source_id, line_number, last_value(command IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS command FROM l")
def t4_active_command(spark, sf_dir):
    so_far = Window.partitionBy("source_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return _session(spark, sf_dir).select("source_id", "line_number", F.last("command", ignorenulls=True).over(so_far).alias("command"))


_IDS = "CASE rule " + " ".join(f"WHEN {k} THEN {lit(r.id)}" for k, r in enumerate(tr.RULES)) + " END"


@query(f"WITH {LINES} SELECT source_id, line_number, {_IDS} AS rule_id FROM l WHERE rule IS NOT NULL")
def t5_rule_match(spark, sf_dir):
    hit = _session(spark, sf_dir).where("rule IS NOT NULL")
    return hit.select("source_id", "line_number", tr.pick(F.col("rule"), [r.id for r in tr.RULES]).alias("rule_id"))


def _type_sql(rule: tr.Rule) -> str:
    part = lambda g: group("raw", rule.pattern, g, rule.ignore_case)
    package = ", ".join(group("raw", tr.PACKAGE_CODE_PATTERN, g) for g in (1, 2, 3))
    special = {
        "{1}": part(1), "{last:1}": f"list_last(string_split({part(1)}, '.'))", "{upper:1}": f"coalesce(upper({part(1)}), 'PermissionDenied')", "{package}": f"coalesce({package}, 'PackageManagerError')",
        "{compile}": f"CASE WHEN contains(lower({part(1)}), 'fatal') THEN 'FatalCompileError' ELSE 'CompileError' END",
        "{warning}": f"CASE WHEN contains(lower({part(0)}), 'deprecat') THEN 'DeprecationWarning' ELSE 'Warning' END",
    }
    if rule.error_type in special:
        return special[rule.error_type]
    head, brace, rest = rule.error_type.partition("{")
    if not brace:
        return lit(head)
    groups = ", ".join(part(int(g)) for g in rest.rstrip("}").split("|"))
    return trimmed(f"({lit(head)} || coalesce({groups}, ''))")


_TYPES = "CASE rule " + " ".join(f"WHEN {k} THEN {_type_sql(r)}" for k, r in enumerate(tr.RULES)) + " END"


@query(f"WITH {LINES} SELECT source_id, line_number, {_TYPES} AS error_type FROM l WHERE rule IS NOT NULL")
def t6_error_type(spark, sf_dir):
    return _session(spark, sf_dir).where("rule IS NOT NULL").select("source_id", "line_number", "error_type")


@query(
    f"""WITH {LINES} SELECT source_id, line_number, coalesce(try_cast(coalesce({group("raw", tr.PATH_LINE_PATTERN, 1, True)}, {group("raw", tr.PYTHON_LINE_PATTERN, 1)}, {group("raw", tr.ON_LINE_PATTERN, 1, True)}) AS INT), -1) AS file_line,
    list_sort(list_transform(regexp_extract_all(raw, {lit("(?i)" + tr.PATH_PATTERN)}), lambda p: (length(p), p)))[1][2] AS file_path FROM l"""
)
def t8_paths_and_lines(spark, sf_dir):
    return _session(spark, sf_dir).select("source_id", "line_number", F.coalesce("file_line", F.lit(-1)).alias("file_line"), "file_path")


BLOCKS = f"""{LINES}, c AS (SELECT *, CASE WHEN blank THEN coalesce(lead(frame OR code) OVER w, false) WHEN prompt THEN false WHEN rule IS NOT NULL AND NOT frame AND NOT code THEN false ELSE frame OR code OR more END AS goes_on
      FROM l WINDOW w AS (PARTITION BY source_id ORDER BY line_number)),
    r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY line_number) AS run FROM c),
    h AS (SELECT *, min(CASE WHEN rule IS NOT NULL AND command IS NULL AND NOT blank THEN line_number END) OVER (PARTITION BY source_id, run) AS header FROM r)"""


@query(f"WITH {BLOCKS} SELECT source_id, line_number, header AS block FROM h WHERE line_number >= header")
def t12_blocks(spark, sf_dir):
    return terminal.line_roles(_session(spark, sf_dir)).where("block IS NOT NULL").select("source_id", "line_number", "block")


def _normal_sql() -> str:
    text = swap(trimmed("raw"), tr.TIMESTAMP_PATTERN, "", all_of_them=False)
    text = swap(swap(text, tr.PATH_PATTERN, "<path>", True), r"\b0x[\da-fA-F]+\b", "<addr>")
    text = swap(swap(text, '"[^"]*"', '"…"'), "'[^']*'", "'…'")
    return "lower(" + trimmed(swap(swap(text, r"\b\d[\d.,]*\b", "#"), r"\s+", " ")) + ")"


@query(f"WITH {LINES} SELECT source_id, line_number, {_normal_sql()} AS normalized FROM l WHERE rule IS NOT NULL")
def t17_normalize_line(spark, sf_dir):
    return _session(spark, sf_dir).where("rule IS NOT NULL").select("source_id", "line_number", "normalized")


@query()
def t18_terminal_issues(spark, sf_dir):
    return terminal.issues(_session(spark, sf_dir))


_KINDS = "CASE rule " + " ".join(f"WHEN {k} THEN {lit(r.kind)}" for k, r in enumerate(tr.RULES)) + " END"
_CATEGORIES = "CASE rule " + " ".join(f"WHEN {k} THEN {lit(r.category)}" for k, r in enumerate(tr.RULES)) + " END"


@query(
    f"""WITH {BLOCKS}, k AS (SELECT *, coalesce(line_number > header, false) AS absorbed, coalesce(line_number = header, false) AS heads, {_KINDS} AS kind FROM h)
    SELECT source_id, count(*) FILTER (NOT absorbed AND NOT blank) AS total_lines, count(*) FILTER (NOT blank) AS non_blank_lines, count(command) AS command_count,
    count(*) FILTER (heads AND kind = 'error') AS error_count, count(*) FILTER (heads AND kind = 'warning') AS warning_count,
    count(*) FILTER (frame AND NOT blank AND (absorbed OR (NOT heads AND command IS NULL AND rule IS NULL))) AS stack_frame_count FROM k GROUP BY source_id"""
)
def t25_totals(spark, sf_dir):
    lines = _session(spark, sf_dir)
    return terminal.totals(lines, terminal.line_roles(lines))


@query(
    f"""WITH {BLOCKS}, b AS (SELECT source_id, header, max(line_number) AS last_line FROM h WHERE line_number >= header GROUP BY ALL),
    i AS (SELECT h.source_id, h.line_number AS first_line, b.last_line, {_CATEGORIES} AS category, {_KINDS} AS kind, coalesce({_TYPES}, '') AS error_type, {_normal_sql()} AS normalized FROM h JOIN b ON h.source_id = b.source_id AND h.line_number = b.header)
    SELECT source_id, category, kind, error_type, count(*) AS occurrences, min(first_line) AS first_line, arg_max(last_line, first_line) AS last_line FROM i GROUP BY source_id, category, kind, error_type, normalized"""
)
def t18_issue_groups(spark, sf_dir):
    found = terminal.issues(_session(spark, sf_dir))
    return found.select("source_id", "category", "kind", F.coalesce("error_type", F.lit("")).alias("error_type"), "occurrences", "first_line", "last_line")


@query(f"WITH {GROUPS} SELECT source_id, first_line, message FROM groups WHERE {severity_sql("level || ' ' || message", 'level')} = 'Critical'")
def u1_critical_errors(spark, sf_dir):
    return report.by_severity(_groups(spark, sf_dir), "Critical").select("source_id", "first_line", "message")


@query(f"WITH {GROUPS} SELECT source_id, first_line, round(greatest(occurrences / greatest(max(occurrences) OVER (PARTITION BY source_id), 1) * 100, 4.0), 6) AS bar FROM groups")
def u2_relative_bar(spark, sf_dir):
    return report.relative_bar(_groups(spark, sf_dir)).select("source_id", "first_line", F.round("bar", 6).alias("bar"))


@query(
    f"""WITH {LINES}, n AS (SELECT source_id, command, count(*) AS occurrences, min(line_number) AS first_line FROM l WHERE command IS NOT NULL GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY occurrences DESC, first_line) AS rank FROM n QUALIFY rank <= 10"""
)
def u4_top_commands(spark, sf_dir):
    return report.top_commands(t2_commands(spark, sf_dir))


@query(f"SELECT doc_id AS source_id, regexp_matches(lower('f' || doc_id::VARCHAR || (['.LOG', '.txt', '.json', '.JSONL', '.csv', '.log.gz', ''])[doc_id % 7 + 1]), '\\.(log|txt|json|jsonl)$') AS accepted FROM documents")
def s2_accepted_names(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, (".LOG", ".txt", ".json", ".JSONL", ".csv", ".log.gz", ""))), (F.col("doc_id") % 7).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("source_id"), source.accepted_name(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending)).alias("accepted"))


@query("SELECT doc_id AS source_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE coalesce(text, '') END AS content FROM documents")
def s8_json_bodies(spark, sf_dir):
    whole = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    body = F.when(F.col("doc_id") % 4 == 0, F.lit("{broken")).when(F.col("doc_id") % 4 == 1, F.lit('{"text": [1, 2]}')).otherwise(whole)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("source_id"), body.alias("body"))
    return source.json_bodies(docs).select("source_id", "content")


@query(ORACLES["p1_detect_format"].replace("coalesce(b.format, 'unknown') AS detected_format", "CASE coalesce(b.format, 'unknown') WHEN 'json' THEN 'JSON' WHEN 'syslog' THEN 'Syslog' WHEN 'text' THEN 'Plain Text' ELSE 'Unknown' END AS label"))
def u3_format_label(spark, sf_dir):
    return p1_detect_format(spark, sf_dir).select("source_id", report.format_label(F.col("detected_format")).alias("label"))


@query(f"WITH {ENTRIES} SELECT DISTINCT source_id, strftime(date_trunc('hour', timestamp::TIMESTAMP), '%b %-d, %H:%M') AS label FROM entries")
def u8_bucket_label(spark, sf_dir):
    return logs.time_buckets(_entries(spark, sf_dir)).select("source_id", report.bucket_label(F.col("start")).alias("label")).distinct()


@query("SELECT doc_id AS source_id, round(length(coalesce(text, '')) / 1024, 1) AS kb FROM documents")
def u13_size_kb(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return source.pasted(docs, "text", "doc_id").select("source_id", report.size_kb(F.col("length")).alias("kb"))


@query("SELECT * FROM (VALUES ('FATAL', 'Critical', false), ('CRITICAL', 'Critical', false), ('OutOfMemory', 'Critical', false), ('out of memory', 'Critical', false), ('deadlock', 'Critical', false), ('Database connection failed', 'High', false), ('connection refused', 'High', false), ('timeout', 'High', false), ('ERROR', 'High', false), ('WARN', 'Medium', false)) v(pattern, severity, is_regex)")
def u12_rule_table(spark, sf_dir):
    return report.rule_table(spark)


def rejected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document as a pasted input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return source.rejection(source.pasted(docs, "text", "doc_id")).select("source_id", F.coalesce("status", F.lit(200)).alias("status"))


QUERIES["s4_rejections"] = rejected_inputs
ORACLES["s4_rejections"] = r"SELECT doc_id AS source_id, CASE WHEN length(coalesce(text, '')) > 15728640 THEN 413 WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 400 ELSE 200 END::INT AS status FROM documents"
