"""Text functions of segmentation, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Blank runs to one blank line, runs of spaces to one, lines of digits alone and page labels away.

    The order matters; matches of a rule do not overlap, so of two neighbouring number lines one stays.
    """
    t = F.regexp_replace(text, r"\n\n+", "\n\n")
    t = F.regexp_replace(t, " +", " ")
    t = F.regexp_replace(t, r"\n[0-9]+\n", "\n")
    t = F.regexp_replace(t, r"Page [0-9]+", "")
    return strip(t)


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def title(text: Column) -> Column:
    """The first three filled lines as one, white space collapsed, at most 200 characters."""
    joined = F.array_join(F.slice(filled_lines(text), 1, 3), " ")
    got = F.substring(F.regexp_replace(joined, r"(?U)\s+", " "), 1, 200)
    return F.when(F.coalesce(got, F.lit("")) == "", "Untitled Document").otherwise(got)


def word_count(text: Column) -> Column:
    """Words by white space; 0 for null and blank texts."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))
