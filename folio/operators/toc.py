"""Tables of contents as flat rows: trees, paths, ranges and stops without recursion.

Rows are those of one or many books in reading order. Most operators rest on one observation: going through a book, it
is enough to know for each level the last row seen at it. The parent of a row is the last row of a lower level, and a row
is kept in the tree exactly if the last rows of levels 1, 2, ... up to its own lie behind one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.config import Settings
from folio.operators.running import running
from folio.session import stored


def numbered(toc: DataFrame) -> DataFrame:
    """(book_id, id, title, level, href, section_id, ord): rows of each book once, numbered from 1 in reading order.

    Rows without id, book, level or order are left out; equal orders are told apart by id.
    """
    one = toc.where("id IS NOT NULL AND book_id IS NOT NULL AND level IS NOT NULL AND toc_order IS NOT NULL").dropDuplicates(["id"])
    out = running(one, ["book_id"], "toc_order", "id", ord=("sum", F.lit(1)))
    # written once: what follows reads it several times
    return stored(out.select("book_id", "id", "title", "level", "href", "section_id", F.col("ord").cast("int").alias("ord")))


def _lasts(flat: DataFrame, deepest: int, *more: str) -> DataFrame:
    """``flat`` with columns l1 ... l<deepest>: for each level the struct (ord, title, *more) of the last row at it, the row itself included."""
    high = F.when(F.col("level") > deepest, F.raise_error(F.lit(f"a level exceeds {deepest}")).cast("int")).otherwise(F.col("level"))
    flat = flat.withColumn("level", high)
    at = {f"l{k}": ("max", F.when(F.col("level") == k, F.struct("ord", "title", *more))) for k in range(1, deepest + 1)}
    return running(flat, ["book_id"], "ord", "id", **at)


def _ord(k: int) -> Column:
    return F.coalesce(F.col(f"l{k}.ord"), F.lit(0))


def tree(toc: DataFrame, deepest: int = Settings.deepest_level) -> DataFrame:
    """(book_id, id, title, level, href, section_id, ord, parent_ord, kept, breadcrumb) of each row.

    ``parent_ord`` is the nearest earlier row of a lower level, null for none. ``kept`` says whether the row belongs to
    the tree that admits only children exactly one level deeper; what hangs below a skipped level is not kept. The
    breadcrumb joins the titles from level 1 down and is null for rows that aren't kept. Levels below 1 are not kept.
    """
    at = _lasts(numbered(toc), deepest)
    level, span = F.col("level"), range(1, deepest + 1)
    # each step is stated by itself: nested ones would repeat the expressions inside them
    parent = F.greatest(F.lit(0), *(F.when(level > k, _ord(k)) for k in span))
    kept = level >= 1
    for k in span:
        kept = kept & ((level <= k) | (_ord(k) > (_ord(k - 1) if k > 1 else F.lit(0))))
    crumb = [F.when(level >= k, F.coalesce(F.col(f"l{k}.title"), F.lit(""))) for k in span]
    return at.select("book_id", "id", "title", "level", "href", "section_id", "ord", F.when(parent > 0, parent).alias("parent_ord"), kept.alias("kept"), F.when(kept, F.concat_ws(" > ", *crumb)).alias("breadcrumb"))


def path_ids(toc: DataFrame, deepest: int = Settings.deepest_level) -> DataFrame:
    """(book_id, id, level, ord, path_id): paths such as 001.002.004 that count the rows of a level since the last row above it, in three digits or as many as it takes."""
    flat = numbered(toc)
    at = _lasts(flat, deepest)
    above = F.greatest(F.lit(0), *(F.when(F.col("level") > k, _ord(k)) for k in range(1, deepest + 1)))
    at = at.select("book_id", "id", "title", "level", "ord", above.alias("since"))
    # a flat book is one group of siblings: they are counted by ranges, not in one window
    at = running(stored(at), ["book_id", "level", "since"], "ord", "id", c=("sum", F.lit(1)))
    at = _lasts(at.withColumn("c", F.col("c").cast("int")), deepest, "c")
    parts = []
    for k in range(1, deepest + 1):
        top = F.greatest(F.lit(0), F.lit(0), *(_ord(j) for j in range(1, k)))
        count = F.coalesce(F.when(_ord(k) > top, F.col(f"l{k}.c")).otherwise(0), F.lit(0))
        # lpad would cut counts of more than three digits
        parts.append(F.when(F.col("level") >= k, F.format_string("%03d", count)))
    return at.select("book_id", "id", "level", "ord", F.concat_ws(".", *parts).alias("path_id"))


def under_path(paths: DataFrame, prefix: str) -> DataFrame:
    """Rows of :func:`path_ids` at or below a path, with the path of their parent (null at level 1)."""
    p = F.col("path_id")
    return paths.where((p == prefix) | p.startswith(prefix + ".")).withColumn("parent_path", F.when(F.col("level") > 1, F.regexp_replace(p, r"\.[0-9]+$", "")))


def subtrees(toc: DataFrame, deepest: int = Settings.deepest_level) -> DataFrame:
    """(book_id, id, level, href, ord, end_ord, descendants, has_children, is_chapter, has_content) of each row.

    The descendants of a row are those from the next one up to, without it, ``end_ord``: the next row of its level or
    a lower one, or one behind the last.
    """
    flat = numbered(toc)
    n = flat.groupBy("book_id").agg(F.max("ord").alias("n"))
    back = running(flat, ["book_id"], "ord", "id", backward=True, **{f"n{k}": ("max", F.when(F.col("level") == k, -F.col("ord"))) for k in range(1, deepest + 1)})
    # the next row of each level: of its own level a row sees itself, so that is looked up from the row behind it
    behind = back.select("book_id", (F.col("ord") - 1).alias("ord"), *(F.col(f"n{k}").alias(f"x{k}") for k in range(1, deepest + 1)), F.col("level").alias("next_level"))
    at = flat.join(behind, ["book_id", "ord"], "left").join(n, "book_id")
    end = F.least(F.col("n") + 1, *(F.when(F.col("level") >= k, -F.col(f"x{k}")) for k in range(1, deepest + 1)))
    return at.withColumn("end_ord", end).select(
        "book_id", "id", "level", "href", "ord", "end_ord", (F.col("end_ord") - F.col("ord") - 1).alias("descendants"),
        F.coalesce(F.col("next_level") > F.col("level"), F.lit(False)).alias("has_children"), (F.col("level") == 1).alias("is_chapter"), F.col("section_id").isNotNull().alias("has_content"),
    )


def href_file(c: Column) -> Column:
    """The part of a href before the first ``#``."""
    return F.split_part(c, F.lit("#"), F.lit(1))


def href_anchor(c: Column) -> Column:
    """The part of a href behind the first ``#``; null for none or an empty one."""
    a = F.regexp_extract(c, r"(?s)^[^#]*#(.*)$", 1)
    return F.when(a != "", a)


def stop_anchors(toc: DataFrame, deepest: int = Settings.deepest_level) -> DataFrame:
    """(book_id, id, ord, file, anchor, stop_anchor): where the text of each row with a href ends within its file.

    The stop is the first later row that is no descendant and has an anchor, before the first row of another file.
    A href that is null counts as another file.
    """
    s = subtrees(toc, deepest).withColumn("file", href_file(F.coalesce("href", F.lit("")))).withColumn("anchor", href_anchor(F.col("href")))
    before = s.select("book_id", (F.col("ord") + 1).alias("ord"), F.col("file").alias("was"))
    s = s.join(before, ["book_id", "ord"], "left").withColumn("new", F.when(F.col("file").eqNullSafe(F.col("was")), 0).otherwise(1))
    s = stored(running(stored(s), ["book_id"], "ord", "id", run=("sum", F.col("new"))))
    s = running(s, ["book_id", "run"], "ord", "id", backward=True, nxt=("max", F.when(F.col("anchor").isNotNull(), F.struct((-F.col("ord")).alias("o"), "anchor"))))
    target = s.select("book_id", F.col("ord").alias("end_ord"), F.col("run").alias("run2"), F.col("nxt.anchor").alias("stop"))
    out = s.where("href IS NOT NULL AND href <> ''").join(target, ["book_id", "end_ord"], "left")
    return out.select("book_id", "id", "ord", "file", "anchor", F.when(F.col("run") == F.col("run2"), F.col("stop")).alias("stop_anchor"))


def page_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, id, start_page, end_page): the pages of rows whose href is a page number, the end exclusive.

    ``pages`` has (book_id, n_pages). A range ends where the next page that a row names begins; rows that name the same
    page share its range; the last ends one behind the last page.
    """
    at = toc.where(F.col("href").rlike(r"\A[0-9]+\z") & F.col("book_id").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"]).select("book_id", "id", F.col("href").cast("int").alias("start_page"))
    page = at.select("book_id", "start_page").distinct().join(pages, "book_id")
    # the next page of the same range of pages, or the first one of the next range that has any
    page = page.withColumn("b", F.floor(F.col("start_page") / 4096))
    following = page.groupBy("book_id", "b").agg(F.min("start_page").alias("first")).select("book_id", "b", F.lead("first").over(Window.partitionBy("book_id").orderBy("b")).alias("following"))
    inside = F.lead("start_page").over(Window.partitionBy("book_id", "b").orderBy("start_page"))
    page = page.withColumn("inside", inside).join(following, ["book_id", "b"]).withColumn("end_page", F.coalesce("inside", "following", F.col("n_pages") + 1))
    return at.join(page.select("book_id", "start_page", "end_page"), ["book_id", "start_page"]).select("book_id", "id", "start_page", "end_page")


def stable_ids(books: DataFrame, toc: DataFrame, deepest: int = Settings.deepest_level, with_page: bool = False) -> DataFrame:
    """(book_id, stable_id): SHA-256 over the title and, in reading order, depth and title of each kept row, with its href if asked."""
    t = tree(toc, deepest).where("kept")
    part = F.concat_ws(":", F.col("level").cast("string"), F.coalesce("title", F.lit("")), *([F.coalesce("href", F.lit(""))] if with_page else []))
    parts = t.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x.p).alias("parts"))
    b = books.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("book_id"), F.coalesce("title", F.lit("")).alias("title"))
    return b.join(parts, "book_id", "left").select("book_id", F.sha2(F.concat_ws("|", F.array("title"), F.coalesce("parts", F.array().cast("array<string>"))), 256).alias("stable_id"))


def as_nested(rows: list) -> list[dict]:
    """The tree of one book as nested dictionaries, from collected rows of :func:`tree`; for the edge, where one book is shown."""
    top: list[dict] = []
    at: dict[int, dict] = {}
    for r in sorted((r for r in rows if r.kept), key=lambda r: r.ord):
        node = {"id": r.id, "title": r.title, "level": r.level, "order": r.ord, "href": r.href, "section_id": r.section_id, "children": []}
        at[r.ord] = node
        (at[r.parent_ord]["children"] if r.parent_ord else top).append(node)
    return top
