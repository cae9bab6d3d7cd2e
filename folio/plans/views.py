"""What is shown of the tables: lists and details as projections, one row a thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import facts as f
from folio.operators import toc


def book_list(books: DataFrame) -> DataFrame:
    """(id, title, author, source_format) of each book once, newest first; ties by id."""
    one = books.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("created_at", "title", "author", "source_format")).alias("b"))
    return one.orderBy(F.col("b.created_at").desc_nulls_last(), "id").select("id", "b.title", "b.author", "b.source_format")


def book_detail(books: DataFrame, contents: DataFrame, book_id: str, url: str = "/books/{id}/file") -> dict | None:
    """One book with the address of its file and its tree of contents as nested dictionaries; None if there is none. Only its rows are read."""
    b = books.where(F.col("id") == book_id).orderBy(F.col("created_at").desc_nulls_last()).first()
    if b is None:
        return None
    rows = toc.tree(contents.where(F.col("book_id") == book_id)).collect()
    return {"id": b.id, "title": b.title, "author": b.author, "source_format": b.source_format, "file_url": url.replace("{id}", b.id), "toc": {"level": 0, "title": b.title, "children": toc.as_nested(rows)}}


def facts_bundle(facts: DataFrame, sections: DataFrame, most: int = 10) -> DataFrame:
    """(section_id, extraction_status, n_facts, facts, hints) of each section: facts in order of creation as JSON with empty texts for null, and at most ``most`` hints.

    Facts are given only where the section's latest status is DONE; without facts the lists are empty.
    """
    s = sections.where("id IS NOT NULL").groupBy(F.col("id").alias("section_id")).agg(F.max_by("extraction_status", "created_at").alias("extraction_status"))
    one = F.struct("created_at", "id", F.coalesce("point", F.lit("")).alias("point"), F.coalesce("reason", F.lit("")).alias("reason"), f.tier(F.col("rank")).alias("rank"))
    g = f.released(facts, sections).groupBy("section_id").agg(F.sort_array(F.collect_list(one)).alias("x"))
    g = g.select("section_id", F.size("x").alias("n_facts"), F.to_json(F.transform("x", lambda y: F.struct(y.id.alias("id"), y.point.alias("point"), y.reason.alias("reason"), y["rank"].alias("rank")))).alias("facts"))
    h = f.hints(f.released(facts, sections), most).groupBy("section_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hint_no", "hint"))), lambda y: y.hint).alias("hints"))
    return s.join(g, "section_id", "left").join(h, "section_id", "left").select("section_id", "extraction_status", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("facts", F.lit("[]")).alias("facts"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints"))


def job_messages(jobs: DataFrame, key: str) -> DataFrame:
    """(key, message): each row as a JSON object without the keys that are null."""
    return jobs.select(key, F.to_json(F.struct(*[c for c in jobs.columns])).alias("message"))
