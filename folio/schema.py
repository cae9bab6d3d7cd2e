"""Schemas of the domain tables, and checks that split rows into accepted and rejected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _s(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v) if v not in _SIMPLE else _SIMPLE[v], True) for k, v in fields.items()])


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}

BOOK = _s(id="string", created_at="timestamp", title="string", author="string", source_format="string", file_path="string", source_filename="string")
TOC = _s(id="string", created_at="timestamp", title="string", book_id="string", section_id="string", level="int", toc_order="int", href="string")
SECTION = _s(id="string", created_at="timestamp", raw_text="string", extraction_status="string")
CHUNK = _s(id="string", book_id="string", section_id="string", text="string", chunk_index="int", chunk_level="string", word_count="int", start_char="int", end_char="int", context_text="string", vector="floats")
FACT = _s(id="string", created_at="timestamp", section_id="string", chunk_id="string", point="string", reason="string", rank="int", start_char="int", end_char="int", questions="strings")
SUMMARY = _s(id="string", created_at="timestamp", section_id="string", text="string", attempt_number="int", submitted_at="timestamp")
REPORT = _s(id="string", created_at="timestamp", summary_id="string", score="double", score_delta="double", generated_at="timestamp")
VALIDATION = _s(id="string", created_at="timestamp", atomic_fact_id="string", report_id="string", status="string", evidence="string", confidence="double", improved="boolean")

FACT_STATUS = ("found", "partial", "missing", "contradicted")
EXTRACTION_STATUS = ("NONE", "PENDING", "DONE", "ERROR")


def span_ok(start: Column, end: Column) -> Column:
    """True unless both ends are known and the end isn't behind the start."""
    return start.isNull() | end.isNull() | (end > start)


def checked(df: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows that meet all rules, and the others with the array ``broken`` of the rules they break.

    A rule that is null counts as broken. Rules are evaluated in one pass over each side.
    """
    broken = F.filter(F.array(*(F.when(~F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items())), lambda x: x.isNotNull())
    return df.where(F.size(broken) == 0), df.withColumn("broken", broken).where(F.size("broken") > 0)
