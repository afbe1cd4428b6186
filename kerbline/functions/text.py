"""String helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, the separators U+001C..U+001F included.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column | str) -> Column:
    """Remove white space of every kind (Unicode) from both ends; null stays null."""
    return F.trim(_c(col), F.lit(BLANKS))


def or_blank(col: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_c(col), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return strip(or_blank(col)) == ""


def truthy(col: Column | str) -> Column:
    """True for the texts 1, true and yes in any case, blanks around them aside; null is false."""
    return F.lower(strip(or_blank(_c(col).cast("string")))).isin("1", "true", "yes")


def split_pipe(col: Column | str) -> Column:
    """Parts of a ``|``-joined text, stripped, without blank ones; null gives an empty array."""
    return F.filter(F.transform(F.split(or_blank(col), r"\|", -1), strip), lambda x: x != "")


def join_distinct(values: Column | str) -> Column:
    """``|``-joined distinct non-blank values of an array, first occurrence first."""
    kept = F.filter(F.transform(_c(values), lambda x: strip(or_blank(x))), lambda x: x != "")
    return F.array_join(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))), "|")


def last_segment(col: Column | str) -> Column:
    """Text after the last dot, stripped: ``v2.Environment.Scene`` gives ``Scene``."""
    return strip(F.substring_index(strip(or_blank(col)), ".", -1))


def get_or_blank(values: Column, index: int) -> Column:
    """Element ``index`` (from 0) of an array or the empty string."""
    return F.coalesce(F.get(values, F.lit(index)), F.lit(""))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
