"""Levels and severities: ordered rule lists compiled to CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import found


@dataclass(frozen=True)
class SeverityRule:
    pattern: str
    severity: str
    is_regex: bool = False


# Severity rules in order of priority.
SEVERITY_RULES = (
    SeverityRule("FATAL", "Critical"),
    SeverityRule("CRITICAL", "Critical"),
    SeverityRule("OutOfMemory", "Critical"),
    SeverityRule("out of memory", "Critical"),
    SeverityRule("deadlock", "Critical"),
    SeverityRule("Database connection failed", "High"),
    SeverityRule("connection refused", "High"),
    SeverityRule("timeout", "High"),
    SeverityRule("ERROR", "High"),
    SeverityRule("WARN", "Medium"),
)
# Severities from worst to mildest, and the levels that count as errors.
SEVERITIES = ("Critical", "High", "Medium", "Low")
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
LEVELS = ("FATAL", "CRITICAL", "ERROR", "WARN", "INFO", "DEBUG")


def classify_severity(level: Column, message: Column, rules: tuple[SeverityRule, ...] = SEVERITY_RULES) -> Column:
    hay = F.concat(level, F.lit(" "), message)
    low = F.lower(hay)
    rest = F.when(level == "WARN", "Medium").when(level == "ERROR", "High").otherwise("Low")
    for rule in reversed(rules):
        hit = found(hay, rule.pattern, True) if rule.is_regex else low.contains(rule.pattern.lower())
        rest = F.when(hit, rule.severity).otherwise(rest)
    return rest


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES) - 1)
    for k, name in enumerate(SEVERITIES[:-1]):
        rank = F.when(severity == name, k).otherwise(rank)
    return rank


def normalize_level(raw: Column) -> Column:
    up = F.upper(raw)
    return F.when(up == "WARNING", "WARN").when(up.isin(*LEVELS), up).otherwise("UNKNOWN")
