"""Whole ways through the operators: reading files, chunking and embedding, facts from a model, and the audit of summaries.

Models are called once a row; what they answered is written to the shared folder before it is used more than once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio import providers
from folio.contracts import Chunker, Completion, Embedding, Loader
from folio.operators import audit, chunk, facts, html, toc, vector
from folio.operators.text import words13
from folio.session import stored
from folio.sources import books

#: Loaders by the kind of a file.
LOADERS: dict[str, Loader] = {"epub": books.epub_books}


@dataclass
class ParquetVectors:
    """A :class:`folio.contracts.VectorStore` in folders by book."""

    spark: SparkSession
    path: str
    col: str = "vector"

    def append(self, chunks: DataFrame) -> None:
        books.append_vectors(chunks, self.path, self.col)

    def read(self, book_id: str | None = None, section_id: str | None = None) -> DataFrame:
        return books.vectors(self.spark, self.path, book_id, section_id)

    def search(self, query: list[float], where: Column | None = None, k: int = 5) -> DataFrame:
        return vector.search(self.read(), query, where, k, "id", self.col)

    def delete(self, book_id: str) -> bool:
        return books.delete_vectors(self.spark, self.path, book_id)


def load(files: DataFrame, existing: DataFrame | None = None, loaders: dict[str, Loader] | None = None) -> dict[str, DataFrame]:
    """Tables ``books``, ``toc``, ``sections`` of files (path, content), and ``rejected`` and ``failed`` ones.

    A book's id is the hash of its title and contents, so a file that comes again gives no second book; ``state`` tells
    books that are among ``existing`` (id). Files of a kind without a loader are rejected with a reason, those that can't be read fail with an error.
    """
    loaders = LOADERS if loaders is None else loaders
    known, unknown = books.by_kind(files.withColumn("source_filename", F.regexp_replace("path", r"\A.*/", "")))
    has = F.col("kind").isin(*loaders) if loaders else F.lit(False)
    rejected = unknown.select("path", F.lit("unknown kind").alias("reason")).unionByName(known.where(~has).select("path", F.concat(F.lit("no loader for "), "kind").alias("reason")))
    parts = [load(known.where(F.col("kind") == k)).withColumn("source_format", F.lit(k)) for k, load in loaders.items()]
    spark = files.sparkSession
    if not parts:
        raise ValueError("there are no loaders")
    read = parts[0]
    for p in parts[1:]:
        read = read.unionByName(p)
    read = stored(read)
    good = read.where("error IS NULL")
    rows = good.select(F.col("path").alias("book_id"), F.explode("contents").alias("c")).select("book_id", F.concat_ws("#", "book_id", F.col("c.toc_order").cast("string")).alias("id"), "c.title", "c.level", "c.toc_order", "c.href", F.lit(None).cast("string").alias("section_id"))
    ids = stored(toc.stable_ids(good.select(F.col("path").alias("id"), "title"), rows).withColumnRenamed("book_id", "path"))
    # of files with the same contents the first path stands for the book
    first = ids.groupBy("stable_id").agg(F.min("path").alias("path"))
    b = good.join(first, "path").select(F.col("stable_id").alias("id"), "title", "author", "source_format", F.col("path").alias("file_path"))
    none = spark.createDataFrame([], "id string")
    b = books.ingest(b, existing if existing is not None else none)
    rows = rows.join(first.withColumnRenamed("path", "book_id"), "book_id").withColumn("id", F.sha2(F.concat_ws("|", "stable_id", F.col("toc_order").cast("string")), 256)).drop("book_id").withColumnRenamed("stable_id", "book_id")
    docs = good.join(first, "path").select(F.col("stable_id").alias("book_id"), F.explode("documents").alias("d")).select("book_id", "d.path", "d.html")
    text = html.extract_texts(toc.stop_anchors(rows), docs)
    rows = stored(rows.join(text, ["book_id", "id"], "left").withColumn("section_id", F.when(F.col("markdown").isNotNull(), F.sha2(F.concat(F.lit("section|"), "id"), 256))))
    sections = rows.where("section_id IS NOT NULL").select(F.col("section_id").alias("id"), F.col("markdown").alias("raw_text"), F.lit("NONE").alias("extraction_status"))
    return {"books": b, "toc": rows.drop("markdown"), "sections": sections, "rejected": rejected, "failed": read.where("error IS NOT NULL").select("path", "error")}


def chunked(sections: DataFrame, contents: DataFrame, titles: DataFrame, chunker: Chunker = chunk.chunks) -> DataFrame:
    """Chunks of sections (id, raw_text), each once, with book_id and breadcrumbs of book (id, title), chapter path and section; a section without a row of the contents has no book."""
    t = toc.tree(contents).where("section_id IS NOT NULL").groupBy("section_id").agg(F.min(F.struct("book_id", "ord", "title", "breadcrumb")).alias("t"))
    above = F.when(F.size(F.split("t.breadcrumb", " > ")) > 1, F.regexp_replace("t.breadcrumb", r" > (?:(?! > ).)*\z", ""))
    t = t.select("section_id", F.col("t.book_id").alias("book_id"), F.col("t.title").alias("section_title"), above.alias("chapter_title"))
    b = titles.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    s = sections.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("section_id"), "raw_text").join(t, "section_id", "left").join(b, "book_id", "left")
    return chunker(s).join(t.select("section_id", "book_id"), "section_id", "left")


def embedded(chunks: DataFrame, embedding: Embedding, width: int | None = None) -> DataFrame:
    """``chunks`` with their vectors, written once; vectors of another ``width`` are an error."""
    out = stored(vector.embed(chunks, embedding))
    return vector.of_width(out, "vector", width) if width else out


def extract_facts(chunks: DataFrame, have: DataFrame, call: Completion, at_once: int | None = None, tokens: Column | None = None) -> dict[str, DataFrame]:
    """``facts``, ``status`` of sections, and ``failed`` chunks of chunks (id, section_id, start_char, text) that no fact of ``have`` names.

    A call that fails, and a reply that can't be read, fail their chunk; the others go on.
    """
    todo = facts.not_yet(chunks, have)
    asked = facts.prompts(todo, words13(F.col("text")) if tokens is None else tokens)
    replies = stored(providers.complete(asked, call, at_once))
    good, failed = facts.read_facts(replies)
    failed = stored(failed)
    return {"facts": stored(good), "failed": failed, "status": facts.section_status(todo, failed)}


def evaluate(summaries: DataFrame, sections: DataFrame, known: DataFrame, reports: DataFrame, validations: DataFrame, call: Completion, weighting: str = "as_built", confident: bool = True) -> dict[str, DataFrame]:
    """``validations``, ``reports`` with score and change, ``feedback``, and ``rejected`` summaries with the reason.

    ``summaries`` are all of their sections; those without a report among ``reports`` (report_id, summary_id, score) are checked now, against the facts ``known``. The report's id is a
    hash of the summary's. A summary whose reply can't be read has a report with the score 0, as one without validations has.
    """
    why = audit.gated(summaries.where("id IS NOT NULL").dropDuplicates(["id"]), sections, known)
    todo = summaries.join(why.where("reason IS NULL").select("id"), "id", "left_semi").join(reports.select(F.col("summary_id").alias("id")), "id", "left_anti")
    before = stored(audit.previous(summaries, reports, validations))
    asked = audit.validation_prompts(todo, known, before)
    replies = stored(providers.complete(asked.withColumn("report_id", F.sha2(F.concat(F.lit("report|"), "id"), 256)), call))
    v = stored(audit.read_validations(replies.select("report_id", "content")))
    r = replies.select("report_id", F.col("id").alias("summary_id"))
    scored = stored(r.join(audit.scores(r, v, known, weighting, confident), "report_id"))
    scored = scored.join(before.select(F.col("id").alias("summary_id"), "attempt", "previous_score"), "summary_id").select("report_id", "summary_id", "attempt", "score", (F.col("score") - F.col("previous_score")).alias("score_delta"))
    return {"validations": v, "reports": scored, "feedback": audit.feedback(v, known), "rejected": why.where("reason IS NOT NULL")}
