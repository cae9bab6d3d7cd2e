"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.functions.text import is_blank


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of them is held as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def clean_ids(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` reduced to ``cols``, without rows that lack one of them."""
    out = df.select(*cols)
    for c in cols:
        out = out.where(F.col(c).isNotNull())
    return out


def scanned_ids(toc: DataFrame) -> DataFrame:
    """Ids of sections whose toc row has a bare page number as href."""
    return clean_ids(toc.where(F.col("href").rlike(r"\A\s*[0-9]+\s*\z")), "section_id").distinct()


def reflowable_ids(toc: DataFrame) -> DataFrame:
    """Ids of sections whose toc row has an .xhtml path as href."""
    return clean_ids(toc.where(F.lower("href").contains(".xhtml")), "section_id").distinct()


def texts(sections: DataFrame) -> DataFrame:
    """(section_id, raw_text) of the rows with an id and a text that is not blank; a section may still occur more than once."""
    return sections.where(F.col("id").isNotNull() & ~is_blank(F.col("raw_text"))).select(F.col("id").alias("section_id"), "raw_text")
