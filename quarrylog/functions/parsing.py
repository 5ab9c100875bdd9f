"""Line parsing: structured formats first, then a keyword parser for the rest.

Decisions where the format itself leaves room: structured CRITICAL becomes
FATAL; common access lines count as nginx; syslog is INFO; dynamic values
collapse in the order identifiers, addresses, hex, times, digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import extract, found, is_blank, replace, replace_first, trim
from .severity import normalize_level

# Level keywords and the shape of timestamps.
LEVEL_PATTERN = r"\b(FATAL|CRITICAL|ERROR|WARNING|WARN|INFO|DEBUG)\b"
TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?)|(\d{2}:\d{2}:\d{2})"

_STAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_NAMES = r"(?:FATAL|CRITICAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE)"
PYTHON_PATTERN = rf"^({_STAMP}) - ([^\s]+) - ({_NAMES}) - (.*)$"
TEXT_PATTERN = rf"^\[?({_STAMP})\]?[ \t]+\[?({_NAMES})\]?[ \t:|-]*(.*)$"
ACCESS_PATTERN = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) ([^ "]+)[^"]*" (\d{3}) (\S+)( "[^"]*" "[^"]*")?'
SYSLOG_PATTERN = r"^<\d{1,3}>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^:\[ ]+)(?:\[\d+\])?: (.*)$"


@dataclass(frozen=True)
class Parsed:
    """Columns of a parsed line."""

    format: Column
    level: Column
    timestamp: Column
    message: Column


def first_json(raw: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(raw, f"$['{n}']"), F.lit("")) for n in names])


def line_format(raw: Column, nginx_first: bool = True) -> Column:
    """json, text, nginx, apache, syslog, or null for an unstructured line."""
    json = raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull()
    plain = F.when(found(raw, ACCESS_PATTERN + "$") & extract(raw, ACCESS_PATTERN, 7).isNull() & (not nginx_first), "apache").otherwise("nginx")
    return (
        F.when(json, "json").when(found(raw, SYSLOG_PATTERN), "syslog").when(found(raw, ACCESS_PATTERN), plain)
        .when(found(raw, PYTHON_PATTERN) | found(raw, TEXT_PATTERN), "text")
    )


def collapse(message: Column) -> Column:
    """A message with its dynamic values replaced."""
    out = replace(message, r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<uuid>", True)
    out = replace(out, r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>")
    out = replace(out, r"\b0x[0-9a-f]+\b", "<hex>", True)
    out = replace(out, _STAMP, "<ts>")
    return replace(out, r"\d+", "<n>")


def normalize_local(raw: Column, level: Column, timestamp: Column) -> Column:
    """The message of an unstructured line: time, level and scaffolding off, long numbers collapsed."""
    at = F.instr(raw, timestamp)
    cut = F.concat(F.substring(raw, F.lit(1), at - 1), F.substring(raw, at + F.length(timestamp), F.length(raw)))
    out = F.when(timestamp.isNotNull(), cut).otherwise(raw)
    out = F.when(level.isNotNull(), replace_first(out, LEVEL_PATTERN)).otherwise(out)
    # The patterns and what they become.
    out = replace(out, r"^\s*[\[\(][^\]\)]*[\]\)]\s*", "")
    out = replace(out, r"^[\s:\-|]+", "")
    out = trim(replace(out, r"\b\d{3,}\b", "#"))
    return F.when(out != "", out).otherwise(trim(raw))


def parse_unstructured(raw: Column) -> dict[str, Column]:
    """level, timestamp and message by keywords; null for a blank line."""
    word, stamp = extract(raw, LEVEL_PATTERN), extract(raw, TIMESTAMP_PATTERN)
    message = F.when(word.isNotNull(), normalize_local(raw, word, stamp)).otherwise(trim(raw))
    there = ~is_blank(raw)
    return {"level": F.when(there, normalize_level(word)), "timestamp": F.when(there, stamp), "message": F.when(there, message)}


def http_message(method: Column, path: Column, status: Column) -> Column:
    return F.concat(F.coalesce(method, F.lit("UNKNOWN")), F.lit(" "), F.coalesce(path, F.lit("/")), F.lit(" — "), F.coalesce(status, F.lit("?")))


def http_level(status: Column) -> Column:
    code = status.try_cast("int")
    return F.when(code >= 500, "ERROR").when(code >= 400, "WARN").otherwise("INFO")


def parse(raw: Column, fmt: Column) -> Parsed:
    loose = parse_unstructured(raw)
    access, json = fmt.isin("nginx", "apache"), fmt == "json"
    python, syslog, text = (fmt == "text") & found(raw, PYTHON_PATTERN), fmt == "syslog", fmt == "text"
    named = F.when(json, first_json(raw, "level", "lvl", "severity")).when(python, extract(raw, PYTHON_PATTERN, 3)).when(text, extract(raw, TEXT_PATTERN, 2)).when(syslog, "INFO")
    named = normalize_level(named)
    level = F.when(access, http_level(extract(raw, ACCESS_PATTERN, 5))).when(fmt.isNotNull(), F.when(named == "CRITICAL", "FATAL").otherwise(named)).otherwise(loose["level"])
    stamp = (
        F.when(json, first_json(raw, "timestamp", "ts", "@timestamp")).when(python, extract(raw, PYTHON_PATTERN, 1)).when(text, extract(raw, TEXT_PATTERN, 1))
        .when(access, extract(raw, ACCESS_PATTERN, 2)).when(syslog, extract(raw, SYSLOG_PATTERN, 1)).otherwise(loose["timestamp"])
    )
    body = (
        F.when(json, first_json(raw, "message", "msg", "event")).when(python, extract(raw, PYTHON_PATTERN, 4)).when(text, extract(raw, TEXT_PATTERN, 3))
        .when(access, http_message(extract(raw, ACCESS_PATTERN, 3), extract(raw, ACCESS_PATTERN, 4), extract(raw, ACCESS_PATTERN, 5))).when(syslog, extract(raw, SYSLOG_PATTERN, 4))
    )
    message = F.when(fmt.isNotNull(), F.coalesce(body, trim(raw))).otherwise(loose["message"])
    return Parsed(fmt, level, stamp, message)


def normalized(fmt: Column, message: Column) -> Column:
    return F.when(fmt.isNotNull(), collapse(message)).otherwise(F.lower(message))


def event_time(timestamp: Column) -> Column:
    """A timestamp text as a time in UTC; null where it has no date or isn't valid."""
    dotted = F.regexp_replace(timestamp, ",", ".")
    iso = F.when(dotted.rlike(r"^\d{4}-\d{2}-\d{2}"), dotted.try_cast("timestamp"))
    return F.coalesce(iso, F.try_to_timestamp(timestamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
