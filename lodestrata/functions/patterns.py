"""Risky-call and memory patterns of the analyser baselines, as expressions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calls that are risky by themselves, and a print whose format isn't a literal; fixed patterns.
RISKY_CALLS = [
    r"\bstrcpy\b",
    r"\bstrcat\b",
    r"\bsprintf\b",
    r"\bgets\b",
    r"\bscanf\b",
    r"\bsystem\b",
    r"\bexec[lv]p?\b",
    r"\bmemcpy\b",
    r"\bstrncpy\b",
    r"\bvsprintf\b",
    r"\bprintf\s*\(\s*[A-Za-z_]\w*\s*\)",
]
#: Use after release, allocation without a later null check, bound with <= inside an index; fixed patterns.
REUSE_AFTER_FREE = r"\bfree\s*\(\s*(\w+)\s*\).*?\b\1\b"
UNCHECKED_ALLOC = r"\bmalloc\b(?![\s\S]*\bif\b[\s\S]*NULL)"
BOUND_IN_INDEX = r"\[\s*\w+\s*<=\s*\w+\s*\]"


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, r"\s+", " ")


def risky_call(c: Column) -> Column:
    """1 if any risky call stands in the text, 0 if not or if there is no text."""
    return F.coalesce(c.rlike("|".join(RISKY_CALLS)).cast("int"), F.lit(0))


def memory_flaw(c: Column) -> Column:
    """1 if the text, white space collapsed, matches a memory pattern, 0 if not or if there is no text."""
    flat = collapse_space(c)
    return F.coalesce((flat.rlike(REUSE_AFTER_FREE) | flat.rlike(UNCHECKED_ALLOC) | flat.rlike(BOUND_IN_INDEX)).cast("int"), F.lit(0))
