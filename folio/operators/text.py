"""Cleaning, paragraphs, sentences and sizes of text, as column expressions evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from folio.functions.text import strip, word_count

Counter = Callable[[Column], Column]
#: Sizes of an array of arrays of texts, in the same form.
ArrayCounter = Callable[[Column], Column]


def clean(c: Column) -> Column:
    """Form feeds as line ends, words divided at line ends joined, runs of blanks as one, at most one blank line, trimmed."""
    c = F.regexp_replace(c, "\f", "\n")
    c = F.regexp_replace(c, r"(?U)-[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*([\p{L}\p{N}_])", "$1")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def paragraphs(c: Column) -> Column:
    """Parts of cleaned text between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n+"), strip), lambda x: x != "")


def sentences(paragraph: Column) -> Column:
    """A paragraph cut at white space behind ``.``, ``!`` and ``?``; parts aren't trimmed, empty ones left out."""
    return F.filter(F.split(paragraph, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), lambda x: strip(x) != "")


def words13(c: Column) -> Column:
    """Tokens estimated as 1.3 a word, at least 1."""
    return F.greatest(F.lit(1), F.floor(word_count(c) * 1.3)).cast("int")


def each(count: Counter) -> ArrayCounter:
    """The counter of arrays of arrays of texts of a counter that is a JVM expression."""
    return lambda texts: F.transform(texts, lambda x: F.transform(x, count))


def arrays_counted_by(encode: Callable[[str], int]) -> ArrayCounter:
    """A counter of arrays of arrays of texts from a tokenizer, in Arrow batches: at least 1 a text, null for null.

    An array with a text that ``encode`` fails on counts as null, so that one text doesn't end the job.
    """

    def one(texts):
        if texts is None:
            return None
        try:
            return [[None if x is None else max(1, encode(x)) for x in some] for some in texts]
        except Exception:
            return None

    def count(s: pd.Series) -> pd.Series:
        return s.map(one)

    count.__annotations__ = {"s": pd.Series, "return": pd.Series}
    # so called, it is computed once and not put into the array expressions that use its result, which can't call it
    return F.pandas_udf(count, "array<array<int>>").asNondeterministic()


def counted_by(encode: Callable[[str], int]) -> Counter:
    """A counter of whole columns from a tokenizer; ``encode`` gives the number of tokens of a text.

    It is Python behind Arrow batches, which array expressions can't call: :func:`arrays_counted_by` is for arrays.
    """
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else max(1, encode(x)))

    count.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, "int")
