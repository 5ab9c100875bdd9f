"""Regular expressions written for an engine with ASCII boundaries and wide white space.

The JVM's ``\\b`` knows Unicode letters and its ``\\s`` only ASCII white space.
``portable`` rewrites a pattern so that Spark matches what the rule tables mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def portable(pattern: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif two == r"\b" and not inside:
            out.append(_EDGE)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + portable(pattern))


def extract(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """The leftmost match's group, or null."""
    return F.nullif(F.regexp_extract(text, ("(?i)" if ignore_case else "") + portable(pattern), group), F.lit(""))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, ("(?i)" if ignore_case else "") + portable(pattern), by)


def replace_first(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, rf"(?s)^(.*?)(?:{portable(pattern)})", f"$1{by}")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITE}]")


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps read without computing them again.

    The optimiser copies an expression into filters on its column and so repeats
    it; it doesn't move a filter across a generator. What is only read, and not
    filtered on, needs no stage: unread columns of a plain projection are dropped.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
