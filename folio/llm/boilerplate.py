"""Lines repeated across the sections of one book, found as blocks of a line graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from folio.functions.text import fold_lines
from folio.llm.common import clean_ids, texts
from folio.session import cut, ship


def _lines(c):
    """Lines of ``c`` that are not blank: their number from 1, and the hash of the folded line, null if it has no letter."""
    folded = F.transform(F.split(fold_lines(c), "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.when(x.rlike(r"\p{L}"), F.xxhash64(x)).alias("line"), (x == "").alias("blank")))
    return F.filter(folded, lambda x: ~x.blank)


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one book's kept lines and edges; a block is named by its least line hash."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"]):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "line": list(parent), "block": [root(x) for x in parent]})


def repeated_lines(sections: DataFrame, toc: DataFrame, min_sections: int = 5, min_share: float = 0.2) -> DataFrame:
    """Occurrences of lines that come back in very many sections of a book: (section_id, book_id, line_no, line, block, support).

    Nodes are the folded lines of a book, edges join a line with the next one that is not blank. Both are kept when they
    occur in at least ``min_sections`` and ``min_share`` of the book's sections that are present and not blank. The
    connected components of what is kept are the blocks; every occurrence of a line of a block is returned.

    Null ids, null and blank texts, lines without a letter and toc rows without a section give no rows. A section
    delivered again, or named by several toc rows of a book, counts once. Empty tables give an empty result.
    Which lines go is by this definition a matter of their own support; the blocks tell which of them stand together
    (:func:`blocks`). Counting is pre-aggregated by (book, line), and only lines with enough support are brought together
    by book. A kept line has a share of at least ``min_share``, so a book keeps at most 1 / ``min_share`` times the mean number of
    distinct lines in its sections: this bounds the list of lines held for a book and the group that finds its blocks.
    """
    ship(sections.sparkSession)
    member = clean_ids(toc, "book_id", "section_id").distinct()
    t = texts(sections)
    per_section = t.select("section_id", F.array_distinct(F.filter(F.transform(_lines(F.col("raw_text")), lambda x: x.line), lambda x: x.isNotNull())).alias("lines"))
    per_section = member.join(per_section.dropDuplicates(["section_id"]), "section_id")
    # one row without a line counts the sections of a book, so that one aggregation gives both counts; only what can be kept goes on
    counts = per_section.select("book_id", F.explode(F.array_append("lines", F.lit(None).cast("bigint"))).alias("line")).groupBy("book_id", "line").agg(F.count(F.lit(1)).alias("support"))
    counts = cut(counts.where(F.col("line").isNull() | (F.col("support") >= min_sections)))
    size = counts.where("line IS NULL").select("book_id", F.col("support").alias("n"))
    kept = cut(counts.where("line IS NOT NULL").join(size, "book_id").where(F.col("support") >= F.col("n") * min_share).select("book_id", "line", "support", "n"))
    wanted = member.join(kept.groupBy("book_id").agg(F.collect_list("line").alias("kept")), "book_id")
    wanted = wanted.groupBy("section_id").agg(F.collect_list(F.struct("book_id", "kept")).alias("books"))
    hit = t.join(wanted, "section_id").dropDuplicates(["section_id"])
    hit = hit.select("section_id", "books", F.posexplode(_lines(F.col("raw_text"))).alias("place", "at")).select("section_id", "place", "at.line_no", "at.line", F.explode("books").alias("b"))
    hit = cut(hit.where(F.array_contains("b.kept", F.col("line"))).select("section_id", "b.book_id", "place", "line_no", "line"))
    before = Window.partitionBy("section_id", "book_id").orderBy("place")
    edge = hit.withColumn("a", F.when(F.lag("place").over(before) == F.col("place") - 1, F.lag("line").over(before))).where(F.col("a").isNotNull())
    edge = edge.groupBy("book_id", "a", F.col("line").alias("b")).agg(F.countDistinct("section_id").alias("w"))
    edge = edge.join(kept.select("book_id", "n").distinct(), "book_id").where((F.col("w") >= min_sections) & (F.col("w") >= F.col("n") * min_share)).select("book_id", "a", "b")
    alone = kept.select("book_id", F.col("line").alias("a"), F.col("line").alias("b"))
    # a number of its own, or adaptive execution would give all books to one task
    parts = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = edge.unionByName(alone).repartition(parts, "book_id").groupBy("book_id").applyInPandas(_blocks, "book_id string, line bigint, block bigint")
    block = block.join(kept.select("book_id", "line", "support"), ["book_id", "line"])
    return hit.join(block, ["book_id", "line"]).select("section_id", "book_id", "line_no", "line", "block", "support")


def blocks(found: DataFrame) -> DataFrame:
    """(book_id, block, lines, occurrences, sections, support) of the blocks of :func:`repeated_lines`: how many lines each has, how often and in how many sections any of them stands, and the greatest support of a line."""
    return found.groupBy("book_id", "block").agg(F.countDistinct("line").alias("lines"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("section_id").alias("sections"), F.max("support").alias("support"))


def without_repeated_lines(sections: DataFrame, toc: DataFrame, **how) -> DataFrame:
    """(section_id, text): every section with an id, once, without its repeated lines; null text stays null."""
    gone = repeated_lines(sections, toc, **how).groupBy("section_id").agg(F.collect_set("line_no").alias("gone"))
    once = sections.where(F.col("id").isNotNull()).select(F.col("id").alias("section_id"), "raw_text").dropDuplicates(["section_id"])
    kept = F.filter(F.split("raw_text", "\n"), lambda x, i: ~F.array_contains("gone", i + 1))
    return once.join(gone, "section_id", "left").select("section_id", F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(F.array_join(kept, "\n")).alias("text"))
