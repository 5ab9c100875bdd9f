"""The terminal pipeline: classified lines, blocks, issues, commands and totals.

All matching is done by Catalyst on single lines. What depends on order is a
small automaton over the lines' classes that runs over sorted partitions, one
session after the other; a session is bounded by the size limit of the source.
Only the columns that the automaton reads travel to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terminal_rules as tr
from ..functions.patterns import found, is_blank, replace, staged, trim
from ..functions.severity import severity_rank

ROLES = "source_id string, line_number long, role string, block long"
_ISSUES = (
    "source_id string, issue_no long, rule int, message string, error_type string, file_path string, file_line int, command string, timestamp string, occurrences long, "
    "first_line long, last_line long, stack_count long, stack_trace array<string>, raw_lines array<string>"
)


def classify(lines: DataFrame, rules: tuple[tr.Rule, ...] = tr.RULES) -> DataFrame:
    """Every line with what ``rules``, in their order, say of it; ``rule`` is the position of the first that matches."""
    base = staged(lines.select("source_id", "line_number", "raw"), clean=tr.strip_ansi(F.col("raw")))
    base = staged(base, blank=is_blank(F.col("clean")))
    c = F.col("clean")
    prompt = found(c, tr.PROMPT_PATTERN)
    command = F.when(prompt, F.nullif(trim(replace(c, tr.PROMPT_PATTERN, "")), F.lit("")))
    more = c.startswith(" ") | c.startswith("\t") | F.col("raw").startswith("|") | F.col("raw").startswith(">")
    for text in tr.CONTINUATIONS:
        more = more | c.contains(text)
    marked = staged(
        base, prompt=prompt & ~F.col("blank"), command=command, rule=F.when(~F.col("blank"), tr.rule_index(c, rules)), frame=tr.is_stack_frame(c), code=found(c, tr.CODE_FRAME_PATTERN), more=more
    )
    hit = F.col("rule").isNotNull()
    exception = found(c, tr.EXCEPTION_PATTERN) & hit
    # Plain projections: what a query doesn't read is never computed.
    return marked.withColumns(
        {
            "error_type": tr.error_type(F.col("rule"), c, rules), "file_path": tr.file_path(c), "file_line": tr.line_number(c), "timestamp": tr.timestamp(c), "exception": exception,
            "normalized": F.when(hit, F.lower(tr.normalize_line(c))), "raw_normalized": F.when(exception, F.lower(tr.normalize_line(F.col("raw")))), "raw_trimmed": trim(F.col("raw")), "clean_trimmed": trim(c),
        }
    )


class _Block:
    def __init__(self, line, command) -> None:
        self.rule, self.first, self.last, self.command = int(line.rule), line.line_number, line.line_number, command
        self.message, self.type, self.key = line.clean_trimmed, line.error_type, line.normalized
        self.path, self.at, self.stamp = line.file_path, line.file_line, line.timestamp
        self.stack, self.raws = [], [line.raw]

    def take(self, line, details: bool = True) -> None:
        self.raws.append(line.raw)
        self.last = line.line_number
        if line.frame and not line.blank:
            self.stack.append(line.clean_trimmed)
        if details:
            self.path = self.path or line.file_path
            self.at = line.file_line if self.at is None else self.at

    def promote(self, line) -> None:
        self.take(line, details=False)
        self.message, self.key = line.raw_trimmed, line.raw_normalized
        if self.type in (None, "", "Traceback"):
            self.type = line.raw.split(":")[0].strip()


def _fate(line, following, in_traceback: bool) -> str:
    """What an open block does with the next line: take, promote or end."""
    if line.blank:
        return "take" if following is not None and (following.frame or following.code) else "end"
    if line.prompt:
        return "end"
    if line.rule is not None and not line.frame and not line.code:
        if not in_traceback:
            return "end"
        if line.exception:
            return "promote"
    return "take" if line.frame or line.code or line.more else "end"


def _sessions(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The lines of one session after the other, from batches in order of session and line."""
    held: list = []
    for batch in batches:
        rows = batch.astype(object)
        for line in rows.where(rows.notna(), None).itertuples(index=False):
            if held and line.source_id != held[0].source_id:
                yield held
                held = []
            held.append(line)
    if held:
        yield held


def _in_order(classified: DataFrame, *columns: str) -> DataFrame:
    return classified.select(*columns).repartition("source_id").sortWithinPartitions("source_id", "line_number")


def _walk(lines: list, traceback: int | None) -> Iterator[tuple]:
    """(line, role, block) in line order; a block object comes with its header and with what it takes."""
    block, command = None, None
    for k, line in enumerate(lines):
        if block is not None:
            fate = _fate(line, lines[k + 1] if k + 1 < len(lines) else None, block.rule == traceback)
            if fate != "end":
                if fate == "promote":
                    block.promote(line)
                else:
                    block.take(line, details=not line.blank)
                yield line, "absorbed", block
                block = None if fate == "promote" else block
                continue
            block = None
        if line.blank:
            yield line, "blank", None
        elif line.command:
            command = line.command
            yield line, "command", None
        elif line.rule is not None:
            block = _Block(line, command)
            yield line, "header", block
        else:
            yield line, "frame" if line.frame else "other", None


_LINE = (
    "source_id", "line_number", "raw", "blank", "prompt", "command", "rule", "frame", "code", "more", "error_type", "file_path", "file_line", "timestamp",
    "exception", "normalized", "raw_normalized", "raw_trimmed", "clean_trimmed",
)


def _traceback(rules: tuple[tr.Rule, ...]) -> int | None:
    return next((k for k, r in enumerate(rules) if r.id == tr.RULES[tr.TRACEBACK].id), None)


def line_roles(classified: DataFrame, rules: tuple[tr.Rule, ...] = tr.RULES) -> DataFrame:
    """(source_id, line_number, role, block): role is blank, command, header, absorbed, frame or other; block the header's line."""
    banner = _traceback(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for session in _sessions(batches):
            rows = [(x.source_id, x.line_number, role, None if b is None else b.first) for x, role, b in _walk(session, banner)]
            yield pd.DataFrame(rows, columns=["source_id", "line_number", "role", "block"]).astype({"block": "Int64"})

    return _in_order(classified, *_LINE).mapInPandas(run, ROLES)


def _collect(session: list, rules: tuple[tr.Rule, ...]) -> pd.DataFrame:
    steps = list(_walk(session, _traceback(rules)))  # blocks are complete now
    issues: dict[tuple, dict] = {}
    newest = None
    for line, role, block in steps:
        if role == "header":
            r = rules[block.rule]
            key = (r.category, r.kind, block.type or "", block.key or "")
            issue = issues.get(key)
            if issue is None:
                issue = newest = issues[key] = {
                    "rule": block.rule, "message": block.message, "error_type": block.type, "file_path": block.path, "file_line": block.at, "command": block.command, "timestamp": block.stamp,
                    "occurrences": 0, "first_line": block.first, "stack_count": len(block.stack), "stack_trace": list(block.stack), "raw_lines": list(block.raws),
                }
            issue["occurrences"] += 1
            issue["last_line"] = block.last
            issue["timestamp"], issue["file_path"] = issue["timestamp"] or block.stamp, issue["file_path"] or block.path
            issue["file_line"] = block.at if issue["file_line"] is None else issue["file_line"]
            if len(block.stack) > len(issue["stack_trace"]):
                issue["stack_trace"], issue["stack_count"] = list(block.stack), len(block.stack)
            if len(block.raws) > len(issue["raw_lines"]):
                issue["raw_lines"] = list(block.raws)
        elif role == "frame" and newest is not None:
            newest["stack_count"] += 1
            newest["stack_trace"].append(line.clean_trimmed)
            newest["raw_lines"].append(line.raw)
            newest["file_path"] = newest["file_path"] or line.file_path
            newest["file_line"] = line.file_line if newest["file_line"] is None else newest["file_line"]
    names = [c.split()[0] for c in _ISSUES.split(", ")]
    source = session[0].source_id
    out = pd.DataFrame([{"source_id": source, "issue_no": k, **i} for k, i in enumerate(issues.values())], columns=names)
    return out.astype({"file_line": "Int32"})


def issues(classified: DataFrame, rules: tuple[tr.Rule, ...] = tr.RULES) -> DataFrame:
    """Issues of every session with category, severity, explanation, structured frames and ANSI-free lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for session in _sessions(batches):
            yield _collect(session, rules)

    raw = _in_order(classified, *_LINE).mapInPandas(run, _ISSUES)
    rule = F.col("rule")
    named = raw.withColumns(
        {
            "category": tr.pick(rule, [r.category for r in rules]), "kind": tr.pick(rule, [r.kind for r in rules]), "severity": tr.pick(rule, [r.severity for r in rules]),
            "explanation": tr.pick(rule, [r.explanation for r in rules]), "parsed_stack": tr.stack_frames(F.col("stack_trace")),
            "normalized_lines": F.transform("raw_lines", tr.strip_ansi), "sample_raw": F.array_join("raw_lines", "\n"),
        }
    )
    return named.withColumn("severity_rank", severity_rank(F.col("severity"))).drop("rule")


def ranked(found_issues: DataFrame) -> DataFrame:
    return found_issues.orderBy("source_id", "severity_rank", F.desc("occurrences"), "first_line")


def commands(classified: DataFrame) -> DataFrame:
    """(source_id, command, occurrences, first_line). A prompt ends any block, so every line with a command counts."""
    run = classified.where("command IS NOT NULL")
    return run.groupBy("source_id", "command").agg(F.count("*").alias("occurrences"), F.min("line_number").alias("first_line"))


def totals(classified: DataFrame, roles: DataFrame, rules: tuple[tr.Rule, ...] = tr.RULES) -> DataFrame:
    """Counters per session; total_lines leaves out absorbed lines, non_blank_lines doesn't."""
    kind = F.when(F.col("role") == "header", tr.pick(F.col("rule"), [r.kind for r in rules]))
    both = classified.select("source_id", "line_number", "rule", "blank", "frame").join(roles, ["source_id", "line_number"]).withColumn("kind", kind)
    role = F.col("role")
    return both.groupBy("source_id").agg(
        F.count_if(~role.isin("blank", "absorbed")).alias("total_lines"), F.count_if(~F.col("blank")).alias("non_blank_lines"), F.count_if(role == "command").alias("command_count"),
        F.count_if(F.col("kind") == "error").alias("error_count"), F.count_if(F.col("kind") == "warning").alias("warning_count"),
        F.count_if((role == "frame") | ((role == "absorbed") & F.col("frame") & ~F.col("blank"))).alias("stack_frame_count"),
    )
