"""White space of any kind, names, and other small expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as white space: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def stripped(c: Column | str) -> Column:
    """A text without the white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def has_text(c: Column | str) -> Column:
    """Whether a text is neither null nor white space alone."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(rf"(?U)[^{SPACE[1:]}")


def name_of(c: Column | str) -> Column:
    """One spelling of a name or key: in lower case, without white space at both ends, empty where missing."""
    return F.coalesce(F.lower(stripped(c)), F.lit(""))


def sigmoid(c: Column) -> Column:
    """1 / (1 + exp(-x)); null for null."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
