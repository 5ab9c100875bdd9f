"""Rules that classify a line of terminal output, and what is read from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import TIMESTAMP_PATTERN
from .patterns import extract, found, replace, replace_first, trim


@dataclass(frozen=True)
class Rule:
    """``error_type``: a constant, or a template over the match's groups ({1}, {last:1}, {upper:1})."""

    id: str
    category: str
    pattern: str
    error_type: str
    severity: str = "High"
    kind: str = "error"
    ignore_case: bool = True
    explanation: str | None = None


# Explanations, then the rules in order of priority.
_NPM = "The entered command is not a valid npm command."
_SHELL = "The entered command is not recognized by the shell or program."
_OPTION = "An invalid, unsupported, or misspelled command or option was passed."
_MISSING = "A required command or argument was not provided."
RULES = (
    Rule("cmd-not-recognized", "Command Error", r"""(?:is not recognized as (?:the name of )?(?:a |an )?(?:cmdlet|internal or external command|program|batch file)|The term ['"][^'"]+['"] is not recognized|\bis not a (?:git|valid|known) command\b)""", "CommandNotRecognized", explanation=_SHELL),
    Rule("cmd-unknown-command", "Command Error", r"""\bunknown command\b|\bcommand not found\b|\bcommand ["'][^"']+["'] not found\b""", "UnknownCommand", explanation=_NPM),
    Rule("cmd-invalid-option", "Command Error", r"\b(?:invalid option|unknown option|unrecognized option|unsupported option|bad option|invalid (?:sub)?command|unsupported command)\b", "InvalidOptionOrCommand", explanation=_OPTION),
    Rule("cmd-missing-argument", "Command Error", r"\b(?:missing required argument|missing operand|missing (?:argument|parameter|command)|too few arguments|not enough arguments)\b", "MissingArgument", explanation=_MISSING),
    Rule("next-react-hydration", "Next.js / React", r"Hydration failed|Text content does not match server-rendered HTML|initial UI does not match", "HydrationError"),
    Rule("next-react-invalid-hook", "Next.js / React", r"Invalid hook call|Hooks can only be called inside of the body of a function component", "InvalidHookCall"),
    Rule("next-react-fast-refresh", "Next.js / React", r"Fast Refresh had to perform a full reload|\[\s*Fast Refresh\s*\]\s*rebuilding", "FastRefreshWarning", "Medium", "warning"),
    Rule("next-react-chunk-load", "Next.js / React", r"ChunkLoadError|Loading chunk \d+ failed", "ChunkLoadError"),
    Rule("next-react-general", "Next.js / React", r"Unhandled Runtime Error|Next\.js server error|Server Error in '/[^']*'", "NextRuntimeError"),
    Rule("python-traceback-start", "Python", r"^Traceback \(most recent call last\):", "Traceback"),
    Rule("python-module-not-found", "Python", r"""ModuleNotFoundError:\s*No module named ['"]([^'"]+)['"]""", "ModuleNotFoundError: {1}"),
    Rule("python-import-error", "Python", r"ImportError:\s*(.*)", "ImportError: {1}"),
    Rule("python-syntax-indentation", "Python", r"\b(IndentationError|SyntaxError|TabError):\s*(.*)", "{1}"),
    Rule("python-common-exceptions", "Python", r"\b(NameError|AttributeError|ValueError|KeyError|IndexError|TypeError|ZeroDivisionError|RuntimeError|FileNotFoundError|PermissionError):\s*(.*)", "{1}"),
    Rule("java-thread-exception", "Java / Maven / Gradle", r"""Exception in thread "[^"]*"\s+([\w\.$]+Error|[\w\.$]+Exception):\s*(.*)""", "{last:1}"),
    Rule("java-class-not-found", "Java / Maven / Gradle", r"\b(ClassNotFoundException|NoClassDefFoundError|NoSuchMethodError|NoSuchFieldError):\s*(.*)", "{1}"),
    Rule("java-general-exception", "Java / Maven / Gradle", r"\b(java\.\w+\.[\w\$]+(?:Exception|Error)):\s*(.*)", "{last:1}"),
    Rule("gradle-maven-build-failed", "Java / Maven / Gradle", r"BUILD FAILED in|\[ERROR\] Failed to execute goal|Gradle build failed", "BuildFailed"),
    Rule("docker-daemon-not-running", "Docker / Container", r"Cannot connect to the Docker daemon|Is the docker daemon running", "DockerDaemonOffline", "Critical"),
    Rule("docker-error-response", "Docker / Container", r"Error response from daemon:|docker:\s*Error response", "DockerDaemonError"),
    Rule("docker-build-failed", "Docker / Container", r"""failed to solve:\s*process\s*".*?"\s*did not complete successfully:\s*exit code""", "DockerBuildFailed"),
    Rule("docker-container-exited", "Docker / Container", r"container .*? exited with code \d+", "ContainerExited"),
    Rule("git-fatal", "Git", r"^fatal:\s*(not a git repository|destination path .*? already exists|pathspec .*? did not match|could not read from remote|refusing to merge)", "GitFatal: {1}"),
    Rule("git-push-failed", "Git", r"^error:\s*failed to push some refs to|updates were rejected because", "GitPushFailed"),
    Rule("git-merge-conflict", "Git", r"CONFLICT \((?:content|modify/delete|add/add)\):|Automatic merge failed; fix conflicts", "GitMergeConflict"),
    Rule("db-conn-refused", "Database / Connection", r"ECONNREFUSED|connect ECONNREFUSED|Connection refused", "ECONNREFUSED"),
    Rule("db-conn-reset", "Database / Connection", r"ECONNRESET|Connection reset by peer", "ECONNRESET"),
    Rule("db-specific-drivers", "Database / Connection", r"\b(MongoNetworkError|SequelizeConnectionError|MongoServerSelectionError|RedisConnectionError|OperationalError:\s*\(2003|sqlite3\.OperationalError|KnoxConnectionError|PrismaClientInitializationError)\b", "{1}"),
    Rule("port-in-use", "Port / Process", r"EADDRINUSE|address already in use|port \d+ is already in use", "EADDRINUSE"),
    Rule("out-of-memory", "Port / Process", r"heap out of memory|FATAL ERROR: Reached heap limit|JavaScript heap out of memory|Out of memory: Kill process", "OutOfMemory", "Critical"),
    Rule("segfault", "Port / Process", r"Segmentation fault|core dumped|SIGSEGV|SIGKILL|panic:\s*runtime error", "SegmentationFault", "Critical"),
    Rule("permission-eacces-eperm", "Permission / Access", r"\b(EACCES|EPERM)\b|permission denied|operation not permitted|Access denied for user|sudo:\s*a password is required", "{upper:1}"),
    Rule("network-timeout-dns", "Network / API", r"\b(ETIMEDOUT|ENOTFOUND|getaddrinfo ENOTFOUND|502 Bad Gateway|504 Gateway Timeout|500 Internal Server Error|fetch failed|CORS header 'Access-Control-Allow-Origin' missing)\b", "{1}"),
    Rule("module-not-found", "Dependency / Module", r"""Cannot find module ['"]([^'"]+)['"]|Module not found:\s*Can't resolve ['"]([^'"]+)['"]|Could not find a declaration file for module ['"]([^'"]+)['"]""", "ModuleNotFound: {1|2|3}"),
    Rule("pkg-npm-err", "Package Manager", r"^npm ERR!|^yarn error|^ERR_PNPM_", "{package}"),
    Rule("pkg-eresolve", "Package Manager", r"ERESOLVE unable to resolve dependency tree|peer dependency conflict", "ERESOLVE"),
    Rule("pkg-elifecycles", "Package Manager", r"ELIFECYCLE|Failed at the .*? script", "ELIFECYCLE"),
    Rule("build-tsc-error", "Build / Compile", r"\b(TS\d{4,5}):\s*(.*)", "{1}", ignore_case=False),
    Rule("build-gcc-clang", "Build / Compile", r":\s*(fatal error|error):\s*(.*)", "{compile}"),
    Rule("build-rust-error", "Build / Compile", r"^(error\[E\d{4}\]):\s*(.*)", "{1}"),
    Rule("build-general-failed", "Build / Compile", r"\b(BUILD FAILED|Compilation failed|Failed to compile|Syntax error: Unexpected token)\b", "BuildFailed"),
    Rule("runtime-js-exceptions", "Runtime Error", r"\b(TypeError|ReferenceError|SyntaxError|RangeError|EvalError|URIError|AggregateError|UnhandledPromiseRejection|Uncaught Exception)\b", "{1}"),
    Rule("warning-deprecation", "Warning / Deprecation", r"\b(DeprecationWarning|ExperimentalWarning)\b|^npm WARN|^Warning:|\b(WARNING|WARN)\b", "{warning}", "Medium", "warning"),
)
TRACEBACK = next(k for k, r in enumerate(RULES) if r.id == "python-traceback-start")
# Prompts, stack frames, code frames, paths, line numbers and the code of a package manager.
PROMPT_PATTERN = r"^(?:\$\s+|❯\s*|PS [^>]*>\s*|[A-Za-z]:\\[^>]*>\s*|\w+@[\w.-]+:[^\s$]*\$\s+)"
STACK_PATTERNS = (
    r"^\s+at\s+.*(?:\(|@|\.js|\.ts)",
    r"""^\s*File "[^"]+", line \d+""",
    r"^\s+at\s+[\w\.$_]+\([\w\.$_]+\.java:\d+\)",
    r"^\s+[\w\.$_]+\.[\w\.$_]+\([\w\.$_]+\.java:\d+\)",
    r"^\s*#\d+\s+0x[\da-fA-F]+\s+in\s+",
    r"^\s+\d+:\s+0x[\da-fA-F]+ - ",
    r"^\s*goroutine \d+ \[.*\]:",
    r"^\s+/.*\.go:\d+",
)
CODE_FRAME_PATTERN = r"^\s*>?\s*\d+\s*\|\s*"
SOURCE_ENDINGS = "ts|tsx|js|jsx|mjs|cjs|json|py|go|rb|java|php|cpp|c|h|rs|css|scss|html|yml|yaml|dockerfile|log|txt|sh|sql"
PATH_PATTERN = rf"(?:[A-Za-z]:)?(?:[\\/][\w.@+-]+)+\.(?:{SOURCE_ENDINGS})\b"
PATH_LINE_PATTERN = rf"\.(?:{SOURCE_ENDINGS})[:](\d+)(?::(\d+))?"
PYTHON_LINE_PATTERN = r"""File "[^"]+", line (\d+)"""
ON_LINE_PATTERN = r"\bon line (\d+)\b"
EXCEPTION_PATTERN = r"^[A-Za-z_]\w*(?:Error|Exception|Warning):\s*(.*)"
PACKAGE_CODE_PATTERN = r"npm ERR! code (\S+)|ERR_PNPM_(\S+)|^yarn error\s+(\S+)"
CONTINUATIONS = ("Caused by:", "npm ERR!", "yarn error")
_ANSI = "\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\x1b[PX^_][^\x1b]*\x1b\\\\|\x1b\\[[0-?]*[ -/]*[@-~]|\x1b[ -/]*[0-~]"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, _ANSI, "")


def rule_index(line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule that matches, or null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(found(line, rules[k].pattern, rules[k].ignore_case), k).otherwise(out)
    return out


def _typed(rule: Rule, line: Column) -> Column:
    group = lambda g: extract(line, rule.pattern, g, rule.ignore_case)
    match rule.error_type:
        case "{1}":
            return group(1)
        case "{last:1}":
            return F.element_at(F.split(group(1), r"\."), -1)
        case "{upper:1}":
            return F.coalesce(F.upper(group(1)), F.lit("PermissionDenied"))
        case "{package}":
            return F.coalesce(*[extract(line, PACKAGE_CODE_PATTERN, g) for g in (1, 2, 3)], F.lit("PackageManagerError"))
        case "{compile}":
            return F.when(F.lower(group(1)).contains("fatal"), "FatalCompileError").otherwise("CompileError")
        case "{warning}":
            return F.when(F.lower(group(0)).contains("deprecat"), "DeprecationWarning").otherwise("Warning")
        case text if "{" in text:
            head, _, rest = text.partition("{")
            value = F.coalesce(*[group(int(g)) for g in rest.rstrip("}").split("|")], F.lit(""))
            return trim(F.concat(F.lit(head), value))
        case text:
            return F.lit(text)


def error_type(rule: Column, line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for k, r in enumerate(rules):
        out = F.when(rule == k, _typed(r, line)).otherwise(out)
    return out


def pick(rule: Column, values: list) -> Column:
    """The value of the matched rule."""
    return F.get(F.array(*map(F.lit, values)), rule)


def is_stack_frame(line: Column) -> Column:
    out = F.lit(False)
    for pattern in STACK_PATTERNS:
        out = out | found(line, pattern)
    return out


def file_path(line: Column) -> Column:
    """The shortest path of a source file, the earlier one on a tie."""
    all_paths = F.regexp_extract_all(line, F.lit("(?i)" + PATH_PATTERN.replace(r"\b", r"(?!\w)")), F.lit(0))
    ranked = F.array_sort(F.transform(all_paths, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))
    return F.get(ranked, F.lit(0))["p"]


def line_number(line: Column) -> Column:
    return F.coalesce(extract(line, PATH_LINE_PATTERN, 1, True), extract(line, PYTHON_LINE_PATTERN, 1), extract(line, ON_LINE_PATTERN, 1, True)).try_cast("int")


def normalize_line(line: Column) -> Column:
    # The patterns and what they become.
    out = replace_first(trim(line), TIMESTAMP_PATTERN)
    out = replace(out, PATH_PATTERN, "<path>", True)
    out = replace(out, r"\b0x[\da-fA-F]+\b", "<addr>")
    out = F.regexp_replace(F.regexp_replace(out, '"[^"]*"', '"…"'), "'[^']*'", "'…'")
    return trim(replace(replace(out, r"\b\d[\d.,]*\b", "#"), r"\s+", " "))


def timestamp(line: Column) -> Column:
    return extract(line, TIMESTAMP_PATTERN)


def stack_frames(frames: Column) -> Column:
    """Structured frames of JavaScript-like stack lines; others give none."""
    shape = r"^at (?:(.*?) \()?(.+?):(\d+):(\d+)\)?$"
    part = lambda f, g: F.nullif(F.regexp_extract(f, shape, g), F.lit(""))
    ours = F.filter(frames, lambda f: f.rlike(shape))
    return F.transform(
        ours,
        lambda f: F.struct(
            part(f, 1).alias("function_name"), part(f, 2).alias("file_name"), part(f, 3).cast("int").alias("line_number"), part(f, 4).cast("int").alias("column_number"), f.alias("source")
        ),
    )
