"""Log, access and terminal text derived from the driver's tables.

The expressions are SQL that Spark and DuckDB read alike, so a query and its
oracle see the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LEVEL = """CASE event_id % 8 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'WARN' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'INFO' WHEN 6 THEN 'DEBUG' ELSE 'notice' END"""
_MESSAGE = """CASE event_id % 23
 WHEN 0 THEN 'Database connection failed for user ' || CAST(user_id AS STRING)
 WHEN 1 THEN 'Redis timeout on 10.0.' || CAST(user_id % 5 AS STRING) || '.7:6379'
 WHEN 2 THEN 'out of memory in worker ' || CAST(user_id % 3 AS STRING)
 WHEN 3 THEN 'Failed to connect to postgres at 2026-01-02T03:04:05Z'
 WHEN 4 THEN 'permission denied reading /var/lib/app/' || CAST(user_id % 4 AS STRING) || '.db'
 WHEN 5 THEN 'payment gateway returned code 500 for order 123456'
 WHEN 6 THEN 'deadlock on 0xdeadbeef while retrying'
 WHEN 7 THEN 'a disk full on node ' || CAST(user_id % 6 AS STRING)
 WHEN 8 THEN 'connection refused by kafka:9092'
 WHEN 9 THEN 'rate limit hit by api user ' || CAST(user_id AS STRING)
 WHEN 10 THEN 'request 550e8400-e29b-41d4-a716-44665544' || CAST(1000 + user_id % 7 AS STRING) || ' not found'
 WHEN 11 THEN 'peer fe80:1:2:3:4:5:6:' || CAST(user_id % 9 AS STRING) || ' timed out behind nginx gateway'
 WHEN 12 THEN 'scheduler job of 10:11:12 crash on attempt: 3'
 WHEN 13 THEN 'cannot open C:' || chr(92) || 'data' || chr(92) || 'cache' || chr(92) || 'x' || CAST(user_id % 3 AS STRING) || '.db'
 WHEN 14 THEN 'authentication error: expired token in session 98765432'
 WHEN 15 THEN 'authorization failed: forbidden for order 42'
 WHEN 16 THEN 'error while parsing inventory record 77 in queue'
 WHEN 17 THEN 'retry 5 of upload to azure and aws, mysql worker'
 WHEN 18 THEN 'corrupted page 12 in mongodb on k8s, docker and cloudflare'
 WHEN 19 THEN 'Failed to load elasticsearch index at port 9200'
 WHEN 20 THEN 'memcached lb rabbitmq apache gcp connection reset   by peer '
 WHEN 21 THEN 'at 2026/01/02T03:04:05+01:00 access denied, heap out of memory'
 ELSE 'event ' || event_type || ' done' END"""
_STAMP = "substring(CAST(ts AS STRING), 1, 19)"
APP_LINE = f"{_STAMP} || ' ' || {_LEVEL} || ' ' || {_MESSAGE}"
MIXED_LINE = f"""CASE WHEN event_id % 9 = 0 THEN '{{"level":"error","msg":"' || event_type || ' broke","ts":"2026-01-01T00:00:00Z"}}'
 WHEN event_id % 9 IN (1, 2) THEN '<13>Jan 02 03:04:05 box cron[77]: ' || event_type
 WHEN event_id % 9 = 3 THEN '' WHEN event_id % 9 = 4 THEN 'no structure here' ELSE {APP_LINE} END"""
ACCESS_LINE = """'10.0.0.' || CAST(page_id % 250 AS STRING) || ' - - [04/Mar/2026:08:15:00 +0000] "' || CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END
 || ' /p/' || CAST(page_id AS STRING) || ' HTTP/1.1" ' || CASE page_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '502' WHEN 3 THEN '301' ELSE '500' END || ' 91' || CASE page_id % 2 WHEN 0 THEN ' "-" "agent"' ELSE '' END"""
_OUTPUTS = (
    "TypeError: x is not a function at src/app/main.ts:42:7", "    at run (/srv/app/server.js:10:5)", "npm ERR! code ELIFECYCLE", "bash: foo: command not found", "Error: connect ECONNREFUSED 127.0.0.1:5432",
    "  continued detail line", "fatal: not a git repository", "done in 3s", "java.lang.IllegalStateException: boom 12345", " > 42 | const x = y;", "npm WARN deprecated left-pad@1.3.0", "",
    'main.c:3:5: error: expected "x" on line 9', "Permission denied: /var/log/app.log", "zsh is not a valid command", "tar: invalid option -- z", "cp: missing operand", "Hydration failed because of 2 nodes",
    "Invalid hook call. Hooks can only be called inside", "[Fast Refresh] rebuilding", "ChunkLoadError: Loading chunk 7 failed", "Unhandled Runtime Error", "ModuleNotFoundError: No module named 'yaml'",
    "ImportError: cannot import name q", "IndentationError: unexpected indent", "ValueError: invalid literal 17 at 10:11:12", 'Exception in thread "main" java.lang.NullPointerException: gone',
    "ClassNotFoundException: com.acme.Main", "BUILD FAILED in 3s", "Cannot connect to the Docker daemon at unix:///var/run/docker.sock", "Error response from daemon: conflict",
    'failed to solve: process "/bin/sh -c make" did not complete successfully: exit code 2', "container web_1 exited with code 137", "error: failed to push some refs to origin", "CONFLICT (content): Merge conflict in a.py",
    "read ECONNRESET", "MongoNetworkError: pool gone", "listen EADDRINUSE: address already in use :::3000", "FATAL ERROR: Reached heap limit", "Segmentation fault (core dumped)", "connect ETIMEDOUT 10.0.0.7:443",
    "Cannot find module 'left-pad'", "npm ERR! ERESOLVE unable to resolve dependency tree", "Failed at the app@1.0.0 start script", "src/a.ts(3,4): TS2345: Argument of type", "util.c:9:1: fatal error: x.h missing", "error[E0382]: borrow of moved value",
    "Failed to compile", "ReferenceError: y is not defined", "(node:1) DeprecationWarning: Buffer() at 0x7f3a", '  File "/srv/app/x.py", line 31', "    at com.acme.Main.run(Main.java:17)", "#0 0x7fff12 in main",
    "goroutine 1 [running]:", "    /srv/go/main.go:12", "Caused by: lost lease", "| piped detail", "> quoted detail", "WARNING: disk at 91,5 percent", "peer dependency conflict", "C:/work/app/index.tsx:8 stopped on line 12",
)
_PROMPTS = ("'$ run '", "'user@box:~/src$ make t'", "'PS C:' || chr(92) || 'w> dir '", "'❯ go test '", "'C:' || chr(92) || 'w>type f'", "chr(27) || '[32m$ ' || chr(27) || '[0mls '")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "' || chr(39) || '") + "'"


_OUTPUT = "CASE (conv_id * 5 + turn * 3) % " + str(len(_OUTPUTS)) + " " + " ".join(f"WHEN {k} THEN {_quoted(t)}" for k, t in enumerate(_OUTPUTS)) + " END"
_COLOURED = f"CASE WHEN conv_id % 9 = 4 THEN chr(27) || '[31m' || {_OUTPUT} || chr(27) || '[0m' ELSE {_OUTPUT} END"
_PROMPT = "CASE conv_id % " + str(len(_PROMPTS)) + " " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(_PROMPTS)) + " END"
SESSION_LINE = f"CASE WHEN role = 'user' AND turn % 4 = 0 THEN {_PROMPT} || CAST(conv_id % 7 AS STRING) ELSE {_COLOURED} END"

#: name -> (table, source_id, line_number, raw); also what an oracle selects from.
VIEWS = {
    "app_log": ("events", "CAST(user_id % 4 AS STRING)", "event_id + 1", APP_LINE),
    "mixed_log": ("events", "CAST(event_id % 16 AS STRING)", "event_id + 1", MIXED_LINE),
    "access_log": ("pages", "CAST(page_id % 2 AS STRING)", "page_id + 1", ACCESS_LINE),
    "sessions": ("conversations", "CAST(conv_id AS STRING)", "turn + 1", SESSION_LINE),
}


def lines(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    table, source, number, raw = VIEWS[view]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{source} AS source_id", f"CAST({number} AS BIGINT) AS line_number", f"{raw} AS raw")


def sql(view: str) -> str:
    table, source, number, raw = VIEWS[view]
    return f"{view} AS (SELECT {source} AS source_id, CAST({number} AS BIGINT) AS line_number, {raw} AS raw FROM {table})"
