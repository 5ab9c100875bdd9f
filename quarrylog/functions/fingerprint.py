"""Fingerprints of messages: volatile values out, services and a category in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import found, portable, replace, trim

# Replacements in order (pattern, replacement, ignore case). $1 keeps the first group.
REPLACEMENTS = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>", True),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<ip>", False),
    (r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b", "<ip>", True),
    (r"\b0x[0-9a-f]+\b", "<addr>", True),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>", False),
    (r"\b\d{2}:\d{2}:\d{2}\b", "<ts>", False),
    (r"(?:/[\w.@+-]+){2,}", "<path>", False),
    (r"(?:[A-Z]:)?(?:\\[\w.@+-]+){2,}", "<path>", True),
    (r"\b\d{5,}\b", "<n>", False),
    (r"\b((?:request|response|item|record|row|page|offset|limit|id|code|status|attempt|retry|count|size|total|index)\s*[:#=\s]\s*)\d+\b", "$1<n>", True),
    (r"(:|port\s*)\d{2,5}\b", "$1<port>", True),
)
# Service patterns in order; all that match count.
SERVICES = (
    (r"\bpostgres(?:ql)?\b", "PostgreSQL"), (r"\bmysql\b", "MySQL"), (r"\bmongo(?:db|Client)?\b", "MongoDB"), (r"\bredis\b", "Redis"),
    (r"\bmemcache(?:d)?\b", "Memcached"), (r"\belasticsearch\b", "Elasticsearch"), (r"\brabbitmq\b", "RabbitMQ"), (r"\bkafka\b", "Kafka"),
    (r"\bnginx\b", "Nginx"), (r"\bapache\b", "Apache"), (r"\bdocker\b", "Docker"), (r"\bkubernetes\b|\bk8s\b", "Kubernetes"), (r"\baws\b", "AWS"),
    (r"\bgcp\b|\bgoogle cloud\b", "GCP"), (r"\bazure\b", "Azure"), (r"\bcloudflare\b", "Cloudflare"), (r"\bauth(?:entication)?\b", "Authentication"),
    (r"\bauthoriz(?:ation|e)\b", "Authorization"), (r"\bpayment\b", "Payment"), (r"\border\b", "Order"), (r"\binventory\b", "Inventory"),
    (r"\buser\b", "User"), (r"\bsession\b", "Session"), (r"\bcache\b", "Cache"), (r"\bqueue\b", "Queue"), (r"\bworker\b", "Worker"),
    (r"\bscheduler\b", "Scheduler"), (r"\bgateway\b", "Gateway"), (r"\bloadbalancer\b|\blb\b", "Load Balancer"), (r"\bdatabase\b|\bdb\b", "Database"),
    (r"\bapi\b", "API"),
)
# Category patterns in order; the first that matches counts.
CATEGORIES = (
    (r"\bconnection\s+(?:refused|failed|reset|timeout|error|closed|lost|terminated|unavailable|timed)\b", "Connection"),
    (r"\bconnect(?:ion)?\s+(?:to\s+)?(?:\w+\s+)?(?:failed|error|refused|timeout|timed)\b", "Connection"),
    (r"\btimeout\b|\btimed?\s*out\b", "Timeout"),
    (r"\bout\s+of\s+memory\b|\boom(?:k)?\b|\bheap\s+(?:out\s+of\s+)?memory\b", "Out of Memory"),
    (r"\bdeadlock\b", "Deadlock"),
    (r"\bpermission\s+denied\b|\baccess\s+denied\b|\bEACCES\b|\bEPERM\b", "Permission"),
    (r"\bnot\s+found\b|\bENOTFOUND\b|\b404\b", "Not Found"),
    (r"\bauthentication\b|\bauth\b.*\b(?:fail|error|invalid|expired|token)\b|\bunauthorized\b|\b401\b", "Authentication"),
    (r"\bauthoriz(?:ation|ed)\b.*\b(?:fail|error|denied|forbidden)\b|\bforbidden\b|\b403\b", "Authorization"),
    (r"\bfailed\s+to\s+(?:connect|load|parse|read|write|open|fetch|send|execute|start|initialize)\b", "Failure"),
    (r"\berror\b.*\b(?:parsing|reading|writing|processing|handling|executing)\b", "Processing Error"),
    (r"\bcrash\b|\bsegfault\b|\bsegmentation\s+fault\b|\bSIGSEGV\b", "Crash"),
    (r"\bretry\b|\bretries\b|\bretrying\b", "Retry"),
    (r"\bcorrupt(?:ed)?\b|\bintegrity\b.*\b(?:error|violation|check)\b", "Data Integrity"),
    (r"\b disk\s+(?:full|space|error)\b|\bno\s+space\b", "Disk"),
    (r"\bratelimit\b|\brate\s+limit\b|\bthrottl", "Rate Limit"),
)
GENERAL = "General"


def clean_message(message: Column) -> Column:
    for pattern, by, ignore_case in REPLACEMENTS:
        message = replace(message, pattern, by, ignore_case)
    return trim(replace(message, r"\s+", " "))


def services(message: Column) -> Column:
    """Names of all services the message speaks of, in table order."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("(?i)" + portable(pattern)).alias("pattern")) for pattern, name in SERVICES])
    return F.transform(F.filter(rows, lambda r: F.regexp_like(message, r["pattern"])), lambda r: r["name"])


def category(message: Column) -> Column:
    out = F.lit(GENERAL)
    for pattern, name in reversed(CATEGORIES):
        out = F.when(found(message, pattern, True), name).otherwise(out)
    return out
