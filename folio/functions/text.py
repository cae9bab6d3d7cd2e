"""Column functions on text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python's str methods know it: Unicode white space and the four information separators.
WS = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """``c`` without white space at either end; null stays null."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def words(c: Column) -> Column:
    """The runs of ``c`` without white space, as an array; null gives null."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Number of words; null and blank text have none."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def fold_lines(c: Column) -> Column:
    """``c`` lower-cased, with white space inside lines as one space, none at line ends, and digit runs as ``0``."""
    c = F.regexp_replace(F.lower(c), "[0-9]+", "0")
    c = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    return F.regexp_replace(c, " ?(\n|\\A|\\z) ?", "$1")


def letters_and_numbers(c: Column) -> Column:
    """``c`` lower-cased, keeping only letters and numbers (Unicode L and N)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
