"""Pages given as spans of text: headings by size, Markdown, and texts of page ranges.

A span is (doc_id, page, block, line, span, size, text), pages from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.text import strip
from folio.operators.text import clean

#: Least sizes of headings of level 1, 2 and 3.
SIZES = (20.0, 16.0, 13.0)


def heading_level(size: Column) -> Column:
    """1, 2 or 3 for the size of a heading, else null."""
    return F.when(size >= SIZES[0], 1).when(size >= SIZES[1], 2).when(size >= SIZES[2], 3)


def title(metadata: Column, file_name: Column) -> Column:
    """A document's own title, unless it is empty or a program's, else the file's name without suffix, with capitals."""
    # Parts of titles that programs set.
    program = F.lower(metadata).rlike("microsoft word|untitled|document|scan|copy")
    t = strip(F.coalesce(metadata, F.lit("")))
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\A.*/", ""), r"(?<=.)\.[^.]*\z", "")
    plain = F.translate(stem, "_-", "  ")
    # a capital behind anything that is no letter, as titles in Python have them
    named = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), F.initcap), "")
    return F.when((t != "") & ~program, t).otherwise(named)


def heuristic_toc(spans: DataFrame) -> DataFrame:
    """(doc_id, toc_order, level, title, href): sections that begin at spans of a heading's size with 3 to 99 characters.

    Every entry is of level 1. The first is ``Introduction`` on page 1, even if a heading stands at the very beginning.
    Documents without spans have no rows.
    """
    t = strip(F.col("text"))
    h = spans.where(F.col("doc_id").isNotNull()).select("doc_id", "page", "block", "line", "span", t.alias("title"), (heading_level(F.col("size")).isNotNull() & (F.length(t) > 2) & (F.length(t) < 100)).alias("is"))
    first = h.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.lit("Introduction").alias("title"))
    all_of = h.where("is").drop("is").unionByName(first)
    w = Window.partitionBy("doc_id").orderBy("page", "block", "line", "span")
    return all_of.select("doc_id", F.row_number().over(w).alias("toc_order"), F.lit(1).alias("level"), "title", F.greatest(F.col("page"), F.lit(1)).cast("string").alias("href"))


def contents(outline: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, toc_order, level, title, href): a document's own outline (doc_id, toc_order, level, title, page) where it has one, else :func:`heuristic_toc`.

    Rows of the outline without document, order or level are left out; a missing title is ``Untitled``, a page below 1 counts as 1.
    """
    t = strip(F.coalesce("title", F.lit("")))
    o = outline.where("doc_id IS NOT NULL AND toc_order IS NOT NULL AND level IS NOT NULL")
    own = o.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("toc_order")).alias("toc_order"), F.col("level").cast("int").alias("level"), F.when(t == "", "Untitled").otherwise(t).alias("title"), F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).cast("string").alias("href"))
    return own.unionByName(heuristic_toc(spans.join(o.select("doc_id").distinct(), "doc_id", "left_anti")))


def page_markdown(spans: DataFrame) -> DataFrame:
    """(doc_id, page, markdown) of each page: headings by size, one paragraph a block.

    Within a block all headings come before its body text, whose lines are only known to be complete at its end.
    """
    t = strip(F.col("text"))
    level = heading_level(F.col("size"))
    s = spans.where(F.col("doc_id").isNotNull()).select("doc_id", "page", "block", "line", "span", t.alias("t"), level.alias("level")).where("t <> ''")
    rows = F.sort_array(F.collect_list(F.struct("line", "span", "level", "t")))
    b = s.groupBy("doc_id", "page", "block").agg(rows.alias("r"))
    heads = F.transform(F.filter("r", lambda x: x.level.isNotNull()), lambda x: F.concat(F.repeat(F.lit("#"), x.level), F.lit(" "), x.t))
    body = F.array_join(F.transform(F.filter("r", lambda x: x.level.isNull()), lambda x: x.t), " ")
    b = b.select("doc_id", "page", "block", F.when(body != "", F.array_append(heads, body)).otherwise(heads).alias("p"))
    return b.groupBy("doc_id", "page").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "p"))), lambda x: x.p)), "\n\n").alias("markdown"))


def range_texts(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, id, text): the cleaned pages of each range (book_id, id, start_page, end_page), blank ones left out.

    ``pages`` has (book_id, page, markdown). Ranges are cut into their pages, so the join is on equal keys.
    """
    r = ranges.where("end_page > start_page").select("book_id", "id", F.explode(F.sequence("start_page", F.col("end_page") - 1)).alias("page"))
    j = r.join(pages, ["book_id", "page"]).where("markdown <> ''")
    t = j.groupBy("book_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda x: x.markdown), "\n\n").alias("t"))
    return t.select("book_id", "id", clean(F.col("t")).alias("text")).where("text <> ''")
