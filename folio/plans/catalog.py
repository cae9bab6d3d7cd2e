"""All queries of the core, by name, with the DuckDB SQL they are held against.

Each takes (spark, folder of the tables). Where a table of the domain has no counterpart among the test tables it is
derived here by rules that SQL can repeat: reports and validations from summaries and facts, spans from lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folio.config import Settings
from folio.functions import text as ft
from folio.operators import audit, chunk, facts, html, pdf, text, toc, vector
from folio.plans import views
from folio.schema import checked, span_ok
from folio.session import table
from folio.sources import books
from folio.streaming import jobs

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _once(spark: SparkSession, d: str, name: str = "sections") -> DataFrame:
    return table(spark, d, name).where("id IS NOT NULL").dropDuplicates(["id"])


# ---- sections and text


def section_profile(spark, d):
    """Sections, blank sections and words of each book."""
    m = table(spark, d, "toc_entries").select("book_id", F.col("section_id").alias("id")).where("book_id IS NOT NULL AND id IS NOT NULL").distinct()
    s = _once(spark, d).select("id", ft.word_count(F.col("raw_text")).alias("words"), ft.is_blank(F.col("raw_text")).cast("int").alias("blank"))
    return m.join(s, "id").groupBy("book_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("blank").alias("n_blank"), F.sum("words").alias("n_words"))


def clean_text(spark, d):
    """Cleaned text of each section."""
    return _once(spark, d).select("id", text.clean(F.col("raw_text")).alias("text"))


def sentence_counts(spark, d):
    """Paragraphs, sentences and estimated tokens of each section, by the chunker's own rules."""
    s = _once(spark, d).where("raw_text IS NOT NULL").select("id", text.paragraphs(text.clean(F.col("raw_text"))).alias("p"))
    s = s.withColumn("s", F.flatten(F.transform("p", text.sentences)))
    return s.select("id", F.size("p").alias("n_paragraphs"), F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + text.words13(x)).alias("n_tokens"))


_SMALL = Settings(chunk_size=120, chunk_overlap=30, chunk_context=200)


def chunks_small(spark, d):
    """Chunks of each section at a small size, so that all branches occur."""
    return chunk.chunks(_once(spark, d).select(F.col("id").alias("section_id"), "raw_text"), _SMALL).drop("id")


def chunks_default(spark, d):
    """Chunks of each section at the default sizes, with breadcrumbs."""
    s = _once(spark, d).select(F.col("id").alias("section_id"), "raw_text")
    t = table(spark, d, "toc_entries").where("section_id IS NOT NULL").groupBy("section_id").agg(F.min(F.struct("id", "title", "book_id")).alias("t")).select("section_id", F.col("t.title").alias("section_title"), F.col("t.book_id").alias("book_id"))
    b = _once(spark, d, "books").select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    j = s.join(t, "section_id", "left").join(b, "book_id", "left").withColumn("chapter_title", F.lit(None).cast("string"))
    return chunk.chunks(j).select("section_id", "chunk_index", "text", "word_count", "start_char", "end_char", "chunk_level")


_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, chr(12), chr(10), 'g'), '-{WS}*\n{WS}*([\p{{L}}\p{{N}}_])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"
_STRIP = rf"'^{WS}+|{WS}+$', '', 'g'"
_PARTS = rf"""
s0 AS (SELECT id, any_value(raw_text) AS t FROM sections WHERE id IS NOT NULL GROUP BY id),
c0 AS (SELECT id, {_CLEAN} AS t FROM s0 WHERE t IS NOT NULL),
p0 AS (SELECT id, list_filter(list_transform(regexp_split_to_array(t, '\n\n+'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS p FROM c0),
q0 AS (SELECT id, p, list_transform(p, lambda x: list_filter(string_split(regexp_replace(x, '([.!?]){WS}+', '\1'||chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, {_STRIP}) <> '')) AS s FROM p0)"""


def _w13(x: str) -> str:
    return rf"greatest(1, CAST(floor(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) * 1.3) AS INT))"


def _chunk_sql(size: int, over: int, around: int, rest: str) -> str:
    words = rf"list_filter(regexp_split_to_array(x, '{WS}+'), lambda w: w <> '')"
    return rf"""WITH RECURSIVE {_PARTS},
para AS (SELECT id, unnest(range(1, len(s) + 1)) AS pno, unnest(s) AS ss FROM q0),
sent AS (SELECT id, pno, unnest(range(1, len(ss) + 1)) AS sno, unnest(ss) AS x FROM para),
tok AS (SELECT id, pno, sno, regexp_replace(x, {_STRIP}) AS x, {_w13('x')} AS tok FROM sent),
tokp AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY id, pno) AS INT) AS para FROM tok),
win AS (SELECT id, pno, sno, tok, para, CASE WHEN tok > {size} THEN list_transform(range(0, len({words}), {size}), lambda k: array_to_string(list_slice({words}, k + 1, k + {size}), ' ')) ELSE [x] END AS xs FROM tokp),
pc AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pno, sno, j) AS n, x, alone, first, para, CASE WHEN alone THEN {_w13('x')} ELSE tok END AS tok
 FROM (SELECT id, pno, sno, para, tok, tok > {size} AS alone, unnest(range(1, len(xs) + 1)) AS j, unnest(xs) AS x, sno = 1 AS f0 FROM win) , LATERAL (SELECT f0 AND j = 1 AS first)),
fold AS (
 SELECT id, n, x, tok, 0 AS c, CASE WHEN alone THEN 1 ELSE 0 END AS nxt, CASE WHEN alone THEN 0 ELSE tok END AS cur FROM pc WHERE n = 1
 UNION ALL
 SELECT p.id, p.n, p.x, p.tok, f.nxt + k.k AS c, f.nxt + k.k + CASE WHEN p.alone THEN 1 ELSE 0 END, CASE WHEN p.alone THEN 0 ELSE CASE WHEN k.k = 1 THEN 0 ELSE f.cur END + p.tok END
 FROM fold f JOIN pc p ON p.id = f.id AND p.n = f.n + 1, LATERAL (SELECT CASE WHEN f.cur > 0 AND ((p.first AND f.cur + p.para > {size}) OR p.alone OR f.cur + p.tok > {size}) THEN 1 ELSE 0 END AS k) k),
ch AS (SELECT id, c, string_agg(x, ' ' ORDER BY n) AS body FROM fold GROUP BY id, c),
rev AS (SELECT id, c, x, n, tok, sum(tok) OVER (PARTITION BY id, c ORDER BY n DESC) AS s FROM fold),
tail AS (SELECT id, c + 1 AS c, string_agg(x, ' ' ORDER BY n) AS tail FROM rev WHERE s <= {over} GROUP BY id, c),
tx AS (SELECT id, c, body, CASE WHEN tail IS NOT NULL AND tail <> '' THEN tail || ' ' || body ELSE body END AS text, CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS off FROM ch LEFT JOIN tail USING (id, c)),
{rest}"""


_SIZES = rf"len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> '')) AS word_count, off AS start_char, off + length(body) AS end_char"
_LEVEL = rf"CASE WHEN contains(text, chr(10)||chr(10)) THEN 'paragraph' WHEN regexp_matches(text, '[.!?]{WS}') THEN 'sentence' ELSE 'word_window' END AS chunk_level"
_CHUNK_SMALL = _chunk_sql(120, 30, 200, rf"""
tk AS (SELECT id, c, text, {_w13('text')} AS tok FROM tx),
ctx AS (
 SELECT t.id, t.c, t.c AS lo, t.c AS hi, 200 - t.tok AS lft, true AS more FROM tk t
 UNION ALL
 SELECT x.id, x.c, CASE WHEN l THEN lo - 1 ELSE lo END, CASE WHEN r THEN hi + 1 ELSE hi END, CASE WHEN r THEN left2 - b.tok ELSE left2 END, l OR r
 FROM ctx x LEFT JOIN tk a ON a.id = x.id AND a.c = x.lo - 1 LEFT JOIN tk b ON b.id = x.id AND b.c = x.hi + 1,
 LATERAL (SELECT coalesce(a.tok <= x.lft, false) AS l), LATERAL (SELECT CASE WHEN l THEN x.lft - a.tok ELSE x.lft END AS left2), LATERAL (SELECT coalesce(b.tok <= left2, false) AS r)
 WHERE x.more AND x.lft > 0),
wide AS (SELECT id, c, min(lo) AS lo, max(hi) AS hi FROM ctx GROUP BY id, c),
cx AS (SELECT w.id, w.c, string_agg(t.text, ' ' ORDER BY t.c) AS ctx FROM wide w JOIN tx t ON t.id = w.id AND t.c BETWEEN w.lo AND w.hi GROUP BY w.id, w.c)
SELECT id AS section_id, c AS chunk_index, text, body, {_LEVEL}, {_SIZES}, ctx AS context_text FROM tx JOIN cx USING (id, c)""")
_CHUNK_DEFAULT = _chunk_sql(800, 200, 1500, rf"""
tt AS (SELECT section_id AS id, arg_min(title, e.id) AS title, arg_min(book_id, e.id) AS book_id FROM toc_entries e WHERE section_id IS NOT NULL GROUP BY section_id),
bb AS (SELECT id AS book_id, any_value(title) AS book_title FROM books GROUP BY id)
SELECT tx.id AS section_id, c AS chunk_index, '[' || coalesce(book_title, 'Unknown Book') || ' > ' || coalesce(tt.title, 'Unknown Section') || ']' || chr(10) || text AS text, {_SIZES}, {_LEVEL} FROM tx LEFT JOIN tt USING (id) LEFT JOIN bb USING (book_id)""")

# ---- books, sources


def file_kinds(spark, d):
    """Books by the kind of their file and the media type of their format."""
    b = _once(spark, d, "books")
    return b.select("id", books.file_kind(F.col("source_filename")).alias("kind"), books.media_type(F.col("source_format")).alias("media_type"))


def rejected_files(spark, d):
    """Books whose file's name has no known suffix."""
    return books.by_kind(_once(spark, d, "books").withColumn("source_filename", F.concat("source_filename", F.when(F.length("title") % 3 == 0, ".txt").otherwise(""))))[1].select("id", "source_filename")


def ingest_state(spark, d):
    """Books as new or existing, against those created by the end of 2023."""
    b = table(spark, d, "books")
    return books.ingest(b, b.where("created_at < TIMESTAMP'2024-01-01 00:00:00'")).select("id", "state")


def sections_latest(spark, d):
    """The latest delivery of each section."""
    s = table(spark, d, "sections")
    return books.upsert(s.where("created_at < TIMESTAMP'2024-06-01 00:00:00'"), s.where("created_at >= TIMESTAMP'2024-06-01 00:00:00'")).select("id", "created_at", "raw_text")


def attached_sections(spark, d):
    """Rows of the contents with a href, and the length of the text at it."""
    t = _once(spark, d, "toc_entries")
    x = t.where("section_id IS NOT NULL AND href IS NOT NULL").join(_once(spark, d).select(F.col("id").alias("section_id"), F.col("raw_text").alias("text")), "section_id").groupBy("book_id", "href").agg(F.max("text").alias("text"))
    return books.attach_sections(t, x).select("book_id", "id", "href", F.length("raw_text").alias("n_chars"))


def href_titles(spark, d):
    """Titles from the file names of hrefs."""
    return _once(spark, d, "toc_entries").where("href LIKE '%xhtml%'").select("id", books.title_from_href(F.col("href")).alias("title"))


def pdf_titles(spark, d):
    """Titles of scanned books, where every other has only a program's."""
    b = _once(spark, d, "books").where("lower(source_format) LIKE '%pdf%'")
    return b.select("id", pdf.title(F.when(F.length("title") % 2 == 0, F.col("title")).otherwise("Microsoft Word - scan"), F.lower("source_filename")).alias("title"))


# ---- contents


def toc_tree(spark, d):
    """Parent, place in the tree and breadcrumb of each row of the contents."""
    return toc.tree(table(spark, d, "toc_entries")).select("book_id", "id", "ord", "parent_ord", "kept", "breadcrumb")


def toc_path_ids(spark, d):
    """Hierarchical path of each row of the contents."""
    return toc.path_ids(table(spark, d, "toc_entries")).select("book_id", "id", "path_id")


def toc_under_path(spark, d):
    """What stands below the path 001.001 of each book."""
    return toc.under_path(toc.path_ids(table(spark, d, "toc_entries")), "001.001").select("book_id", "id", "path_id", "parent_path")


def toc_subtrees(spark, d):
    """Descendants and kinds of each row of the contents."""
    return toc.subtrees(table(spark, d, "toc_entries")).drop("href", "level")


def _anchored(spark, d):
    # hrefs with anchors: some rows share the file of the row before them
    t = _once(spark, d, "toc_entries")
    return t.withColumn("href", F.when(F.length("title") % 5 != 0, F.concat(F.lit("f"), F.floor(F.col("toc_order") / 4).cast("string"), F.lit(".xhtml"), F.when(F.length("title") % 4 != 0, F.concat(F.lit("#a"), F.col("toc_order").cast("string"))).otherwise(""))))


def toc_stop_anchors(spark, d):
    """Where the text of each row of the contents ends within its file."""
    return toc.stop_anchors(_anchored(spark, d))


def toc_page_ranges(spark, d):
    """Pages of each row of scanned books' contents."""
    t = table(spark, d, "toc_entries")
    pages = t.where(F.col("href").rlike("^[0-9]+$")).groupBy("book_id").agg((F.max(F.col("href").cast("int")) + 9).alias("n_pages"))
    return toc.page_ranges(t, pages)


def stable_ids_epub(spark, d):
    """A hash of title and contents of each book."""
    return toc.stable_ids(table(spark, d, "books"), table(spark, d, "toc_entries"))


def stable_ids_pdf(spark, d):
    """A hash of title, contents and pages of each book."""
    return toc.stable_ids(table(spark, d, "books"), table(spark, d, "toc_entries"), with_page=True)


def _spans(spark, d):
    # every line of a scanned section as a span whose size depends on its length
    ids = table(spark, d, "toc_entries").where(F.col("href").rlike("^[0-9]+$")).select(F.col("section_id").alias("id")).distinct()
    s = _once(spark, d).join(ids, "id", "left_semi").where("raw_text IS NOT NULL").select(F.col("id").alias("doc_id"), F.posexplode(F.split("raw_text", "\n")).alias("n", "text"))
    return s.select("doc_id", (F.floor(F.col("n") / 30) + 1).cast("int").alias("page"), F.floor(F.col("n") / 6).cast("int").alias("block"), F.col("n").alias("line"), F.lit(0).alias("span"), (F.lit(9.0) + F.length("text") % 13).alias("size"), "text")


def pdf_headings(spark, d):
    """Contents by the sizes of spans."""
    return pdf.heuristic_toc(_spans(spark, d))


def pdf_pages(spark, d):
    """Pages as Markdown."""
    return pdf.page_markdown(_spans(spark, d))


def pdf_range_texts(spark, d):
    """Texts of the page ranges of scanned documents' own contents."""
    s = _spans(spark, d)
    h = pdf.heuristic_toc(s).select(F.col("doc_id").alias("book_id"), F.concat_ws("-", "doc_id", "toc_order").alias("id"), "href")
    n = s.groupBy(F.col("doc_id").alias("book_id")).agg(F.max("page").alias("n_pages"))
    return pdf.range_texts(toc.page_ranges(h, n), pdf.page_markdown(s).withColumnRenamed("doc_id", "book_id"))


def html_texts(spark, d):
    """Texts at the anchors of made-up files that hold the sections of four rows of the contents each."""
    t = _anchored(spark, d).where("section_id IS NOT NULL")
    s = _once(spark, d).select(F.col("id").alias("section_id"), "raw_text")
    part = F.concat(F.lit('<h2 id="a'), F.col("toc_order").cast("string"), F.lit('">'), F.regexp_replace(F.coalesce("title", F.lit("")), "[<&]", ""), F.lit("</h2><p>"), F.regexp_replace(F.regexp_replace(F.coalesce("raw_text", F.lit("")), "[<&]", ""), "\n\n", "</p><p>"), F.lit("</p>"))
    f = t.join(s, "section_id").groupBy("book_id", F.concat(F.lit("f"), F.floor(F.col("toc_order") / 4).cast("string"), F.lit(".xhtml")).alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("toc_order", "id", part.alias("p")))), lambda x: x.p), "").alias("b"))
    return html.extract_texts(toc.stop_anchors(_anchored(spark, d)), f.select("book_id", "path", F.concat(F.lit("<html><body>"), "b", F.lit("</body></html>")).alias("html")))


# ---- facts


# files with anchors, and the text at them: (case, html, anchor, stop, Markdown)
_PAGE = '<html><head><title>t</title></head><body><nav>menu</nav><p>Intro <i>text</i>.</p><section id="a"><h2>A</h2><p>ta</p><section><p>inner</p></section></section><h2 id="h">H</h2><p>th</p><script>x()</script><div><p>more</p><p id="stop">z</p></div><p class="chapter"><a name="old"></a>C</p><p>tc <b>bold</b></p><ul><li>one</li><li>two</li></ul></body></html>'
HTML_CASES = (
    ("container", _PAGE, "a", None, "## A\n\nta"),
    ("heading to stop", _PAGE, "h", "stop", "## H\n\nth\n\nmore"),
    ("name in a paragraph like a heading", _PAGE, "old", None, "C\n\ntc **bold**\n\n * one\n * two"),
    ("paragraph in a block", _PAGE, "stop", None, "more\n\nz\n\nC\n\ntc **bold**\n\n * one\n * two"),
    ("no anchor", _PAGE, None, None, "Intro _text_."),
    ("missing anchor", _PAGE, "zz", None, None),
    ("whole body", "<html><body id='b'><p>One</p><p>Two</p></body></html>", "b", None, "One\n\nTwo"),
    ("next section", '<html><body><h1 id="sec7-1">7.1</h1><p>First.</p><h1 id="sec7-2">7.2</h1><p>Second.</p></body></html>', "sec7-1", "sec7-2", "# 7.1\n\nFirst."),
    ("heading behind the anchor", '<html><body><p>x</p><a id="k"></a><h3>K</h3><p>tk</p></body></html>', "k", None, "### K\n\ntk"),
    ("heading around the anchor", '<html><body><h4><span id="s">S</span></h4><p>ts</p><hr/><blockquote><p>said</p></blockquote></body></html>', "s", None, "#### S\n\nts\n\n* * *\n\n> said"),
    ("broken markup", "<html><body><p id='m'>one<p>two<ul><li>a<li>b</ul>", "m", None, "one\n\ntwo\n\n * a\n * b"),
    ("empty", "", None, None, None),
)


def html_cases(spark, d):
    """Texts at the anchors of files that show each way an anchor is understood."""
    rows = spark.createDataFrame([("b", n, f"{k}.xhtml", a, s) for k, (n, _, a, s, _) in enumerate(HTML_CASES)], "book_id string, id string, file string, anchor string, stop_anchor string")
    files = spark.createDataFrame([("b", f"./{k}.xhtml", h) for k, (_, h, _, _, _) in enumerate(HTML_CASES)], "book_id string, path string, html string")
    return html.extract_texts(rows, files).select("id", "markdown")


def pdf_contents(spark, d):
    """Contents of scanned documents: those of every other book have an outline of their own."""
    s = _spans(spark, d)
    o = s.groupBy("doc_id").agg(F.max("page").alias("n")).where("length(doc_id) > 0 AND conv(substr(doc_id, -1), 16, 10) % 2 = 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(3)))).alias("page"))
    o = o.select("doc_id", (F.col("page") * 10).alias("toc_order"), F.when(F.col("page") == 1, 1).otherwise(2).alias("level"), F.when(F.col("page") < 3, F.concat(F.lit(" Part "), F.col("page").cast("string"))).alias("title"), "page")
    return pdf.contents(o, s)


def fact_checks(spark, d):
    """Facts with their coerced rank, weights, span, and the rules they break."""
    f = table(spark, d, "atomic_facts")
    ok, bad = checked(f, span=span_ok(F.col("start_char"), F.col("end_char")), point=F.col("point").isNotNull())
    r = facts.tier(F.col("rank"))
    cols = ["id", r.alias("tier"), facts.weight(r, "documented").alias("weight")]
    return ok.select(*cols, F.lit("").alias("broken")).union(bad.select(*cols, F.array_join("broken", ",")))


def rank_names(spark, d):
    """Ranks spelt in many ways, coerced."""
    f = table(spark, d, "atomic_facts").withColumn("n", F.length(F.coalesce("point", F.lit(""))) % 8)
    s = F.when(F.col("n") == 0, "Critical").when(F.col("n") == 1, "IMPORTANT").when(F.col("n") == 2, "nuance").when(F.col("n") == 3, "2").when(F.col("n") == 4, "99").when(F.col("n") == 5, "0").when(F.col("n") == 6, "invalid")
    return f.groupBy(facts.tier(s).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def facts_released(spark, d):
    """Facts of sections that are done."""
    return facts.released(table(spark, d, "atomic_facts"), table(spark, d, "sections")).select("id", "section_id")


def facts_grounding(spark, d):
    """The pieces of text that facts' spans cover."""
    return facts.grounding(table(spark, d, "atomic_facts").dropDuplicates(["id"]), table(spark, d, "sections"))


def fact_hints(spark, d):
    """Hints of each section."""
    return facts.hints(table(spark, d, "atomic_facts"))


def _replies(spark, d):
    # stored replies: each chunk's facts as JSON, wrapped in several ways, some broken
    f = table(spark, d, "atomic_facts").where("chunk_id IS NOT NULL AND section_id IS NOT NULL")
    one = F.struct("point", F.col("rank").cast("string").alias("rank"), "reason", "start_char", "end_char", "questions", (F.length("id") % 7 == 0).alias("from_overlap"))
    g = f.groupBy("chunk_id").agg(F.min("section_id").alias("section_id"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("o")))), lambda x: x.o)).alias("j"), F.min("id").alias("first"))
    # some are JSON without a list, and some mark the overlap by a text, which marks nothing
    k = F.conv(F.substring("first", 1, 2), 16, 10).cast("int") % 7
    content = F.when(k == 0, F.col("j")).when(k == 1, F.concat(F.lit('{"facts": '), "j", F.lit("}"))).when(k == 2, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(k == 3, F.concat(F.lit('{"note": None, "items": '), "j", F.lit("}"))).when(k == 4, "sorry, no facts").when(k == 5, '{"note": "there are none"}').otherwise(F.replace("j", F.lit('"from_overlap":true'), F.lit('"from_overlap":"true"')))
    return g.select("chunk_id", "section_id", F.lit(0).alias("start_char"), content.alias("content"))


def facts_read(spark, d):
    """Facts read from stored replies."""
    return facts.read_facts(_replies(spark, d))[0].select("chunk_id", "point", "reason", "rank", "start_char", "end_char", F.size("questions").alias("n_questions"))


def extraction_status(spark, d):
    """Status of sections after their chunks' replies were read."""
    r = _replies(spark, d)
    return facts.section_status(r.select(F.col("chunk_id").alias("id"), "section_id"), facts.read_facts(r)[1])


def chunks_not_yet(spark, d):
    """Chunks without facts among those whose replies can be read."""
    r = _replies(spark, d)
    return facts.not_yet(r.select(F.col("chunk_id").alias("id"), "section_id"), facts.read_facts(r)[0])


def fact_limits(spark, d):
    """How many facts each section may give, and its text behind the first line."""
    return _once(spark, d).where("raw_text IS NOT NULL").select("id", facts.max_facts(text.words13(F.col("raw_text"))).alias("max_facts"), F.length(facts.without_header(F.col("raw_text"))).alias("n_body"))


# ---- audit


def _validations(spark, d):
    return audit.read_validations(_validation_replies(spark, d))


def _validation_replies(spark, d):
    # stored replies: a status by rule for each fact of a summary's section, as JSON that is wrapped in several ways
    s = table(spark, d, "summaries").where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("report_id"), "section_id", "text", "attempt_number")
    f = table(spark, d, "atomic_facts").where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("atomic_fact_id"), "section_id", "point")
    k = (F.length(F.coalesce("point", F.lit(""))) + F.length(F.coalesce("text", F.lit("")))) % 4
    status = F.when(k == 0, "found").when(k == 1, "partial").when(k == 2, "missing").otherwise("contradicted")
    n = F.length(F.coalesce("point", F.lit("")))
    one = F.struct(F.col("atomic_fact_id").alias("fact_id"), F.when(n % 3 == 0, F.upper(status)).otherwise(status).alias("status"), ((n % 101) / 100).alias("confidence"))
    g = s.join(f, "section_id").select("report_id", one.alias("o")).groupBy("report_id").agg(F.to_json(F.collect_list("o")).alias("j"))
    k = F.conv(F.substring("report_id", -1, 1), 16, 10).cast("int") % 4
    odd = F.concat(F.lit('[{"fact_id": null, "status": "found"}, {"fact_id": "x", "status": "perhaps"}, 7, '), F.substring("j", 2, 1 << 30))
    content = F.when(k == 0, F.col("j")).when(k == 1, F.concat(F.lit('{"results": '), "j", F.lit(', "note": None}'))).when(k == 2, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(odd)
    return g.select("report_id", content.alias("content"))


def validations_read(spark, d):
    """Validations read from stored replies."""
    return _validations(spark, d).drop("improved")


def summary_previous(spark, d):
    """The attempt before each summary, with its score and digest."""
    r = _scored(spark, d).withColumn("summary_id", F.col("report_id"))
    p = audit.previous(table(spark, d, "summaries"), r, _validations(spark, d))
    return p.select("id", "attempt", "previous_id", "previous_report", F.round("previous_score", 6).alias("previous_score"), "digest")


def _reports(spark, d):
    s = audit.attempts(table(spark, d, "summaries").where("id IS NOT NULL").dropDuplicates(["id"]))
    return s.select("section_id", "attempt", F.col("id").alias("report_id"))


def _facts(spark, d):
    return table(spark, d, "atomic_facts")


def summary_gates(spark, d):
    """Why summaries can't be audited."""
    return audit.gated(table(spark, d, "summaries"), table(spark, d, "sections"), _facts(spark, d))


def summary_lengths(spark, d):
    """Summaries long and short by section."""
    ok, bad = audit.long_enough(table(spark, d, "summaries"))
    return ok.withColumn("ok", F.lit(1)).union(bad.withColumn("ok", F.lit(0))).groupBy("section_id").agg(F.sum("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))


def summary_attempts(spark, d):
    """Attempts, counted."""
    return audit.attempts(table(spark, d, "summaries")).select("id", "section_id", "attempt")


def latest_attempts(spark, d):
    """The latest attempt of each section."""
    return audit.latest_attempt(table(spark, d, "summaries"), table(spark, d, "sections"))


def _scored(spark, d, weighting="as_built", confident=True):
    return audit.scores(_reports(spark, d), _validations(spark, d), _facts(spark, d), weighting, confident)


def score_as_built(spark, d):
    """Scores with the weights 1, 2, 3 and confidence."""
    return _scored(spark, d).select("report_id", F.round("score", 6).alias("score"))


def score_documented(spark, d):
    """Scores with the weights 3, 2, 1 and without confidence."""
    return _scored(spark, d, "documented", False).select("report_id", F.round("score", 6).alias("score"))


def score_deltas(spark, d):
    """Changes of scores between attempts."""
    return audit.deltas(_reports(spark, d).join(_scored(spark, d), "report_id")).select("report_id", F.round("score_delta", 6).alias("score_delta"))


def audit_feedback(spark, d):
    """Feedback on each fact."""
    return audit.feedback(_validations(spark, d), _facts(spark, d)).drop("confidence")


def audit_outcomes(spark, d):
    """Facts by status, and the digest of each report."""
    v = _validations(spark, d)
    return audit.outcome(v).select("report_id", F.size("mastered").alias("n_mastered"), F.size("omissions").alias("n_omissions"), F.size("misconceptions").alias("n_misconceptions")).join(audit.digest(v), "report_id")


def audit_history(spark, d):
    """All reports of each section."""
    h = audit.history(_reports(spark, d).join(_scored(spark, d), "report_id"), _validations(spark, d), _facts(spark, d))
    return h.withColumn("score", F.round("score", 6)).withColumn("score_delta", F.round("score_delta", 6))


# ---- views


def book_list(spark, d):
    """Books as they are listed."""
    return views.book_list(table(spark, d, "books"))


def facts_bundle(spark, d):
    """Facts and hints of each section as they are shown."""
    return views.facts_bundle(_facts(spark, d), table(spark, d, "sections"), 2).withColumn("hints", F.array_join("hints", "|"))


def job_messages(spark, d):
    """Summaries as messages without null keys."""
    s = table(spark, d, "summaries").where("id IS NOT NULL").dropDuplicates(["id"]).select("id", "section_id", F.when(F.col("attempt_number") > 1, F.col("attempt_number")).alias("attempt"))
    return views.job_messages(s, "id")


# ---- vectors, streams, relational coverage


def vector_search(spark, d):
    """The five nearest vectors with label 3 to a given one."""
    return vector.search(table(spark, d, "embeddings"), [((7 * k) % 13) / 13 - 0.5 for k in range(64)], F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_neighbours(spark, d):
    """The five nearest others of each vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return vector.nearest(v, v.where("vec_id % 50 = 0")).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def job_states(spark, d):
    """The latest event of each user, by a stream over all there is."""
    schema = table(spark, d, "events").schema
    s = jobs.table_stream(spark, d, schema, "events.parquet")
    return jobs.drained(jobs.latest(s, "user_id", "ts", "event_id", "event_type"), "job_states")


def event_windows(spark, d):
    """Events by hour and type, by a stream over all there is."""
    schema = table(spark, d, "events").schema
    s = jobs.table_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.drained(jobs.windowed(s, "ts", "1 hour", "10 minutes", "event_type"), "event_windows")


def order_rollup(spark, d):
    """Revenue by nation, customer segment and both together."""
    li, o, c, n = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    rev = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = o.join(rev, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "c_mktsegment").agg(F.round(F.sum("r"), 2).alias("revenue"))


def top_orders(spark, d):
    """The three dearest orders of each segment."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", "rank", "o_orderkey", "o_totalprice")


def customers_without_orders(spark, d):
    """Customers without orders in 1997."""
    o = table(spark, d, "orders").where("o_orderdate >= DATE'1997-01-01' AND o_orderdate < DATE'1998-01-01'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    section_profile, clean_text, sentence_counts, chunks_small, chunks_default, file_kinds, rejected_files, ingest_state, sections_latest, attached_sections, href_titles, pdf_titles,
    toc_tree, toc_path_ids, toc_under_path, toc_subtrees, toc_stop_anchors, toc_page_ranges, stable_ids_epub, stable_ids_pdf, pdf_headings, pdf_pages, pdf_range_texts, pdf_contents, html_texts, html_cases,
    fact_checks, rank_names, facts_released, facts_grounding, fact_hints, facts_read, extraction_status, chunks_not_yet, fact_limits,
    summary_gates, summary_lengths, summary_attempts, latest_attempts, validations_read, summary_previous, score_as_built, score_documented, score_deltas, audit_feedback, audit_outcomes, audit_history,
    book_list, facts_bundle, job_messages, vector_search, vector_neighbours, job_states, event_windows, order_rollup, top_orders, customers_without_orders,
)}

# ---- SQL

_ONCE = "SELECT id, any_value(raw_text) AS t FROM sections WHERE id IS NOT NULL GROUP BY id"
_FLAT = """f AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY toc_order, id) AS INT) AS ord FROM (SELECT DISTINCT ON (id) * FROM toc_entries WHERE id IS NOT NULL AND book_id IS NOT NULL AND level IS NOT NULL AND toc_order IS NOT NULL))"""
_PAR = f"WITH RECURSIVE {_FLAT}, p AS (SELECT f.*, (SELECT max(g.ord) FROM f g WHERE g.book_id = f.book_id AND g.ord < f.ord AND g.level < f.level) AS parent_ord FROM f)"
_KEPT = _PAR + """, k AS (SELECT book_id, ord, level, coalesce(title, '') AS crumb FROM p WHERE level = 1 AND parent_ord IS NULL
 UNION ALL SELECT p.book_id, p.ord, p.level, k.crumb || ' > ' || coalesce(p.title, '') FROM p JOIN k ON p.book_id = k.book_id AND p.parent_ord = k.ord AND p.level = k.level + 1)"""
_END = f"WITH {_FLAT}, e AS (SELECT f.*, coalesce((SELECT min(g.ord) FROM f g WHERE g.book_id = f.book_id AND g.ord > f.ord AND g.level <= f.level), (SELECT max(g.ord) + 1 FROM f g WHERE g.book_id = f.book_id)) AS end_ord FROM f)"
_PATHS = _PAR + """, a AS (SELECT p.*, i.l AS lv, (SELECT count(*) FROM p g WHERE g.book_id = p.book_id AND g.level = i.l AND g.ord <= p.ord AND g.ord > coalesce((SELECT max(h.ord) FROM p h WHERE h.book_id = p.book_id AND h.ord <= p.ord AND h.level < i.l), 0)) AS c
 FROM p, (SELECT unnest(range(1, 9)) AS l) i WHERE i.l <= p.level), paths AS (SELECT book_id, id, level, string_agg(CASE WHEN c < 1000 THEN lpad(CAST(c AS VARCHAR), 3, '0') ELSE CAST(c AS VARCHAR) END, '.' ORDER BY lv) AS path_id FROM a GROUP BY book_id, id, level)"""
_V = """f1 AS (SELECT DISTINCT ON (id) * FROM atomic_facts WHERE id IS NOT NULL), s1 AS (SELECT DISTINCT ON (id) * FROM summaries WHERE id IS NOT NULL),
v AS (SELECT s1.id AS report_id, f1.id AS atomic_fact_id, ['found','partial','missing','contradicted'][1 + (length(coalesce(point, '')) + length(coalesce(text, ''))) % 4] AS status, (length(coalesce(point, '')) % 101) / 100.0 AS confidence, coalesce(point, '') AS point,
 CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS rank FROM s1 JOIN f1 USING (section_id)),
rep AS (SELECT id AS report_id, section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY submitted_at NULLS LAST, id) AS INT) AS attempt FROM s1 WHERE section_id IS NOT NULL)"""


def _score(weight: str, conf: str) -> str:
    return f"sc AS (SELECT report_id, coalesce(CAST(sum({weight} * CASE status WHEN 'found' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END * {conf}) AS DOUBLE) / sum({weight}) * 100, 0) AS score FROM rep LEFT JOIN v USING (report_id) GROUP BY report_id)"


_DELTA = "dl AS (SELECT section_id, attempt, report_id, score, score - lag(score) OVER (PARTITION BY section_id ORDER BY attempt, report_id) AS score_delta FROM rep JOIN sc USING (report_id))"
_SPAN = r"""sp AS (SELECT id AS doc_id, n // 30 + 1 AS page, n // 6 AS block, n AS line, 9.0 + length(text) % 13 AS size, regexp_replace(text, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS t
 FROM (SELECT id, unnest(range(0, len(a))) AS n, unnest(a) AS text FROM (SELECT id, string_split(t, chr(10)) AS a FROM (""" + _ONCE + r""") WHERE t IS NOT NULL AND id IN (SELECT section_id FROM toc_entries WHERE regexp_full_match(href, '[0-9]+')))))"""
_HEADS = "hd AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS INT) AS toc_order, title, CAST(greatest(page, 1) AS VARCHAR) AS href FROM (SELECT doc_id, page, line, t AS title FROM sp WHERE size >= 13 AND length(t) BETWEEN 3 AND 99 UNION ALL SELECT DISTINCT doc_id, 0, -1, 'Introduction' FROM sp))"
_PAGES = """bl AS (SELECT doc_id, page, block, list_concat(coalesce(list(CASE WHEN size >= 20 THEN '# ' WHEN size >= 16 THEN '## ' ELSE '### ' END || t ORDER BY line) FILTER (WHERE size >= 13), []), CASE WHEN count(*) FILTER (WHERE size < 13) > 0 THEN [string_agg(t, ' ' ORDER BY line) FILTER (WHERE size < 13)] ELSE [] END) AS p FROM sp WHERE t <> '' GROUP BY doc_id, page, block),
pg AS (SELECT doc_id, page, array_to_string(flatten(list(p ORDER BY block)), chr(10)||chr(10)) AS markdown FROM bl GROUP BY doc_id, page)"""
_READ = """fr AS (SELECT * FROM atomic_facts WHERE chunk_id IS NOT NULL AND section_id IS NOT NULL), kc AS (SELECT chunk_id, min(section_id) AS section_id, CAST('0x' || substr(min(id), 1, 2) AS INT) % 7 AS k FROM fr GROUP BY chunk_id),
rd AS (SELECT chunk_id, coalesce(point, '') AS point, coalesce(reason, '') AS reason, CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS rank, start_char, end_char, coalesce(len(questions), 0) AS n_questions FROM fr JOIN kc USING (chunk_id) WHERE k NOT IN (4, 5) AND (k = 6 OR length(id) % 7 <> 0) AND (start_char IS NULL OR end_char IS NULL OR end_char > start_char))"""

SQL = {
    "section_profile": rf"""WITH m AS (SELECT DISTINCT book_id, section_id AS id FROM toc_entries WHERE book_id IS NOT NULL AND section_id IS NOT NULL),
w AS (SELECT id, coalesce(len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '')), 0) AS n FROM ({_ONCE}))
SELECT book_id, count(*) AS n_sections, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS n_blank, sum(n) AS n_words FROM m JOIN w USING (id) GROUP BY book_id""",
    "clean_text": f"SELECT id, {_CLEAN} AS text FROM ({_ONCE})",
    "sentence_counts": f"WITH {_PARTS} SELECT id, len(p) AS n_paragraphs, len(flatten(s)) AS n_sentences, CAST(coalesce(list_sum(list_transform(flatten(s), lambda x: {_w13('x')})), 0) AS INT) AS n_tokens FROM q0",
    "chunks_small": _CHUNK_SMALL,
    "chunks_default": _CHUNK_DEFAULT,
    "file_kinds": r"SELECT DISTINCT ON (id) id, CASE WHEN lower(source_filename) LIKE '%.epub' THEN 'epub' WHEN lower(source_filename) LIKE '%.pdf' THEN 'pdf' END AS kind, CASE regexp_replace(lower(trim(source_format)), '^\.', '') WHEN 'epub' THEN 'application/epub+zip' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type FROM books WHERE id IS NOT NULL",
    "rejected_files": "SELECT * FROM (SELECT DISTINCT ON (id) id, source_filename || CASE WHEN length(title) % 3 = 0 THEN '.txt' ELSE '' END AS source_filename FROM books WHERE id IS NOT NULL) WHERE NOT regexp_matches(lower(source_filename), '\\.(epub|pdf)$')".replace("\\\\", "\\"),
    "ingest_state": "SELECT id, CASE WHEN min(created_at) < TIMESTAMPTZ '2024-01-01 00:00:00+00' THEN 'exists' ELSE 'new' END AS state FROM books WHERE id IS NOT NULL GROUP BY id",
    "sections_latest": "SELECT id, max(created_at) AS created_at, arg_max(raw_text, created_at) AS raw_text FROM sections WHERE id IS NOT NULL GROUP BY id",
    "attached_sections": f"WITH e AS (SELECT DISTINCT ON (id) * FROM toc_entries WHERE id IS NOT NULL), x AS (SELECT book_id, href, max(t) AS t FROM e JOIN ({_ONCE}) s ON s.id = e.section_id WHERE href IS NOT NULL GROUP BY book_id, href) SELECT e.book_id, e.id, e.href, length(coalesce(x.t, '')) AS n_chars FROM e LEFT JOIN x USING (book_id, href) WHERE e.href IS NOT NULL AND e.href <> ''",
    "href_titles": r"SELECT DISTINCT ON (id) id, trim(translate(regexp_replace(string_split(string_split(href, '#')[1], '/')[-1], '(?i)\.(xhtml|html|htm)$', ''), '_-', '  ')) AS title FROM toc_entries WHERE href LIKE '%xhtml%'",
    "pdf_titles": r"""WITH b AS (SELECT DISTINCT ON (id) id, title, translate(regexp_replace(regexp_replace(lower(source_filename), '^.*/', ''), '(.)\.[^.]*$', '\1'), '_-', '  ') AS stem FROM books WHERE id IS NOT NULL AND lower(source_format) LIKE '%pdf%')
SELECT id, CASE WHEN length(title) % 2 = 0 AND NOT regexp_matches(lower(title), 'microsoft word|untitled|document|scan|copy') AND trim(title) <> '' THEN trim(title) ELSE array_to_string(list_transform(regexp_extract_all(stem, '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') END AS title FROM b""",
    "toc_tree": _KEPT + " SELECT p.book_id, p.id, p.ord, p.parent_ord, k.ord IS NOT NULL AS kept, k.crumb AS breadcrumb FROM p LEFT JOIN k USING (book_id, ord)",
    "toc_path_ids": _PATHS + " SELECT book_id, id, path_id FROM paths",
    "toc_under_path": _PATHS + r" SELECT book_id, id, path_id, CASE WHEN level > 1 THEN regexp_replace(path_id, '\.[0-9]+$', '') END AS parent_path FROM paths WHERE path_id = '001.001' OR starts_with(path_id, '001.001.')",
    "toc_subtrees": _END + " SELECT book_id, id, ord, end_ord, end_ord - ord - 1 AS descendants, coalesce(lead(level) OVER (PARTITION BY book_id ORDER BY ord) > level, false) AS has_children, level = 1 AS is_chapter, section_id IS NOT NULL AS has_content FROM e",
    "toc_stop_anchors": _END.replace("SELECT DISTINCT ON (id) * FROM toc_entries", "SELECT DISTINCT ON (id) * REPLACE (CASE WHEN length(title) % 5 <> 0 THEN 'f' || CAST(toc_order // 4 AS VARCHAR) || '.xhtml' || CASE WHEN length(title) % 4 <> 0 THEN '#a' || CAST(toc_order AS VARCHAR) ELSE '' END END AS href) FROM toc_entries")
    + """, g AS (SELECT *, string_split(coalesce(href, ''), '#')[1] AS file, CASE WHEN contains(href, '#') THEN string_split(href, '#')[2] END AS anchor FROM e)
SELECT g.book_id, g.id, g.ord, g.file, g.anchor, (SELECT arg_min(h.anchor, h.ord) FROM g h WHERE h.book_id = g.book_id AND h.ord >= g.end_ord AND h.anchor IS NOT NULL AND h.file = g.file
 AND NOT EXISTS (SELECT 1 FROM g i WHERE i.book_id = g.book_id AND i.ord > g.ord AND i.ord < h.ord AND i.file <> g.file)) AS stop_anchor FROM g WHERE href IS NOT NULL AND href <> ''""",
    "toc_page_ranges": "WITH e AS (SELECT DISTINCT ON (id) book_id, id, CAST(href AS INT) AS s FROM toc_entries WHERE regexp_full_match(href, '[0-9]+') AND book_id IS NOT NULL AND id IS NOT NULL), p AS (SELECT book_id, s, coalesce(lead(s) OVER (PARTITION BY book_id ORDER BY s), max(s) OVER (PARTITION BY book_id) + 10) AS n FROM (SELECT DISTINCT book_id, s FROM e)) SELECT book_id, id, s AS start_page, n AS end_page FROM e JOIN p USING (book_id, s)",
    "stable_ids_epub": _KEPT + ", j AS (SELECT p.book_id, string_agg(CAST(p.level AS VARCHAR) || ':' || coalesce(p.title, ''), '|' ORDER BY p.ord) AS s FROM p JOIN k USING (book_id, ord) GROUP BY p.book_id) SELECT b.id AS book_id, sha256(coalesce(b.title, '') || coalesce('|' || j.s, '')) AS stable_id FROM (SELECT DISTINCT ON (id) * FROM books WHERE id IS NOT NULL) b LEFT JOIN j ON j.book_id = b.id",
    "stable_ids_pdf": _KEPT + ", j AS (SELECT p.book_id, string_agg(CAST(p.level AS VARCHAR) || ':' || coalesce(p.title, '') || ':' || coalesce(p.href, ''), '|' ORDER BY p.ord) AS s FROM p JOIN k USING (book_id, ord) GROUP BY p.book_id) SELECT b.id AS book_id, sha256(coalesce(b.title, '') || coalesce('|' || j.s, '')) AS stable_id FROM (SELECT DISTINCT ON (id) * FROM books WHERE id IS NOT NULL) b LEFT JOIN j ON j.book_id = b.id",
    "pdf_headings": f"WITH {_SPAN}, {_HEADS} SELECT doc_id, toc_order, 1 AS level, title, href FROM hd",
    "pdf_pages": f"WITH {_SPAN}, {_PAGES} SELECT doc_id, page, markdown FROM pg",
    "pdf_range_texts": f"""WITH {_SPAN}, {_HEADS}, {_PAGES}, u AS (SELECT doc_id, CAST(href AS INT) AS s, lead(CAST(href AS INT)) OVER (PARTITION BY doc_id ORDER BY CAST(href AS INT)) AS e FROM (SELECT DISTINCT doc_id, href FROM hd)),
r AS (SELECT hd.doc_id, hd.doc_id || '-' || CAST(toc_order AS VARCHAR) AS id, u.s, coalesce(u.e, (SELECT max(page) + 1 FROM sp WHERE sp.doc_id = u.doc_id)) AS e FROM hd JOIN u ON u.doc_id = hd.doc_id AND u.s = CAST(hd.href AS INT)),
x AS (SELECT r.doc_id, r.id, string_agg(markdown, chr(10)||chr(10) ORDER BY page) AS t FROM r JOIN pg ON pg.doc_id = r.doc_id AND page >= s AND page < e AND markdown <> '' GROUP BY r.doc_id, r.id)
SELECT * FROM (SELECT doc_id AS book_id, id, {_CLEAN} AS text FROM x) WHERE text <> ''""",
    "html_cases": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (n, m)) + ")" for n, _, _, _, m in HTML_CASES if m) + ") t(id, markdown)",
    "pdf_contents": f"""WITH {_SPAN}, {_HEADS}, o AS (SELECT doc_id, unnest(range(1, least(max(page), 3) + 1)) AS p FROM sp WHERE CAST('0x' || right(doc_id, 1) AS INT) % 2 = 0 GROUP BY doc_id)
SELECT doc_id, CAST(p AS INT) AS toc_order, CASE WHEN p = 1 THEN 1 ELSE 2 END AS level, CASE WHEN p < 3 THEN 'Part ' || p ELSE 'Untitled' END AS title, CAST(p AS VARCHAR) AS href FROM o
UNION ALL SELECT doc_id, toc_order, 1, title, href FROM hd WHERE CAST('0x' || right(doc_id, 1) AS INT) % 2 = 1""",
    "validations_read": f"WITH {_V} SELECT report_id, atomic_fact_id, status, '' AS evidence, confidence FROM v",
    "summary_previous": f"WITH {_V}, {_score('rank', 'confidence')}, g AS (SELECT report_id, " + " || chr(10) || ".join(f"'  {s.capitalize():<14}' || coalesce(string_agg(atomic_fact_id, ', ' ORDER BY atomic_fact_id) FILTER (WHERE status = '{s}'), 'none')" for s in ("found", "partial", "missing", "contradicted")) + """ AS digest FROM v GROUP BY report_id),
p AS (SELECT report_id AS id, attempt, lag(report_id) OVER (PARTITION BY section_id ORDER BY attempt) AS previous_id FROM rep)
SELECT p.id, attempt, previous_id, sc.report_id AS previous_report, round(score, 6) AS previous_score, digest FROM p LEFT JOIN sc ON sc.report_id = previous_id LEFT JOIN g ON g.report_id = previous_id""",
    "fact_checks": "SELECT id, CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS tier, 4 - CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS weight, array_to_string(list_filter([CASE WHEN end_char <= start_char THEN 'span' END, CASE WHEN point IS NULL THEN 'point' END], lambda x: x IS NOT NULL), ',') AS broken FROM atomic_facts",
    "rank_names": "SELECT CASE length(coalesce(point, '')) % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS tier, count(*) AS n FROM atomic_facts GROUP BY 1",
    "facts_released": "SELECT id, section_id FROM atomic_facts WHERE section_id IN (SELECT id FROM (SELECT id, arg_max(extraction_status, created_at) AS s FROM sections GROUP BY id) WHERE s = 'DONE')",
    "facts_grounding": f"SELECT f.id, CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS rank, 4 - CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS weight, end_char - start_char AS span_length, CASE WHEN end_char > start_char THEN substr(t, start_char + 1, end_char - start_char) END AS grounding FROM (SELECT DISTINCT ON (id) * FROM atomic_facts) f LEFT JOIN ({_ONCE}) s ON s.id = f.section_id",
    "fact_hints": "SELECT section_id, hint_no, hint FROM (SELECT section_id, questions[1] AS hint, CAST(row_number() OVER (PARTITION BY section_id ORDER BY CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END, created_at NULLS LAST, id) AS INT) AS hint_no FROM atomic_facts WHERE section_id IS NOT NULL AND len(questions) > 0) WHERE hint_no <= 5",
    "facts_read": f"WITH {_READ} SELECT * FROM rd",
    "extraction_status": f"WITH {_READ} SELECT section_id, CASE WHEN max(CASE WHEN k = 4 THEN 1 ELSE 0 END) = 1 THEN 'ERROR' ELSE 'DONE' END AS status FROM kc GROUP BY section_id",
    "chunks_not_yet": f"WITH {_READ} SELECT chunk_id AS id, section_id FROM kc WHERE chunk_id NOT IN (SELECT chunk_id FROM rd)",
    "fact_limits": f"SELECT id, CAST(least(8, greatest(3, {_w13('t')} // 150)) AS INT) AS max_facts, CASE WHEN contains(t, chr(10)) THEN length(t) - strpos(t, chr(10)) ELSE length(t) END AS n_body FROM ({_ONCE}) WHERE t IS NOT NULL",
    "summary_gates": f"SELECT m.id, m.section_id, CASE WHEN s.id IS NULL THEN 'no such section' WHEN coalesce(st, '') <> 'DONE' THEN 'section not done' WHEN coalesce(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')), 0) < 50 THEN 'too short' WHEN m.section_id NOT IN (SELECT section_id FROM atomic_facts WHERE section_id IS NOT NULL) THEN 'no facts' END AS reason FROM summaries m LEFT JOIN (SELECT id, arg_max(extraction_status, created_at) AS st FROM sections WHERE id IS NOT NULL GROUP BY id) s ON s.id = m.section_id",
    "summary_lengths": f"SELECT section_id, sum(CASE WHEN coalesce(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')), 0) >= 50 THEN 1 ELSE 0 END) AS n_ok, count(*) AS n FROM summaries GROUP BY section_id",
    "summary_attempts": "SELECT id, section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY submitted_at NULLS LAST, id) AS INT) AS attempt FROM summaries WHERE section_id IS NOT NULL",
    "latest_attempts": "SELECT s.id AS section_id, coalesce(max(attempt_number), 0) AS latest FROM (SELECT DISTINCT id FROM sections WHERE id IS NOT NULL) s LEFT JOIN summaries m ON m.section_id = s.id GROUP BY s.id",
    "score_as_built": f"WITH {_V}, {_score('rank', 'confidence')} SELECT report_id, round(score, 6) AS score FROM sc",
    "score_documented": f"WITH {_V}, {_score('(4 - rank)', '1.0')} SELECT report_id, round(score, 6) AS score FROM sc",
    "score_deltas": f"WITH {_V}, {_score('rank', 'confidence')}, {_DELTA} SELECT report_id, round(score_delta, 6) AS score_delta FROM dl",
    "audit_feedback": f"WITH {_V} SELECT report_id, atomic_fact_id, point, rank, status, '' AS evidence, CASE status WHEN 'found' THEN 'You have ' || w || '.' WHEN 'partial' THEN 'You have part of ' || w || '.' WHEN 'missing' THEN 'You left out ' || w || '.' ELSE 'You got ' || w || ' wrong.' END AS message FROM (SELECT *, ['a key point', 'an important point', 'a detail'][rank] AS w FROM v)",
    "audit_outcomes": "WITH " + _V + ", g AS (SELECT report_id, " + ", ".join(f"coalesce(string_agg(atomic_fact_id, ', ' ORDER BY atomic_fact_id) FILTER (WHERE status = '{s}'), 'none') AS {s}, count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("found", "partial", "missing", "contradicted")) + " FROM v GROUP BY report_id) SELECT report_id, n_found AS n_mastered, n_missing AS n_omissions, n_contradicted AS n_misconceptions, '  Found         ' || found || chr(10) || '  Partial       ' || partial || chr(10) || '  Missing       ' || missing || chr(10) || '  Contradicted  ' || contradicted AS digest FROM g",
    "audit_history": f"WITH {_V}, {_score('rank', 'confidence')}, {_DELTA}, c AS (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE status = 'found') AS k FROM v GROUP BY report_id) SELECT section_id, attempt, report_id, round(score, 6) AS score, round(score_delta, 6) AS score_delta, coalesce(n, 0) AS n_facts, coalesce(k, 0) AS n_found FROM dl LEFT JOIN c USING (report_id)",
    "book_list": "SELECT DISTINCT ON (id) id, title, author, source_format FROM books WHERE id IS NOT NULL ORDER BY id, created_at DESC NULLS LAST, title DESC",
    "facts_bundle": """WITH s AS (SELECT id AS section_id, arg_max(extraction_status, created_at) AS extraction_status FROM sections WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT *, CASE WHEN rank IN (1, 2, 3) THEN rank ELSE 3 END AS tier FROM atomic_facts JOIN s USING (section_id) WHERE extraction_status = 'DONE'),
g AS (SELECT section_id, count(*) AS n, '[' || string_agg('{"id":' || to_json(id) || ',"point":' || to_json(coalesce(point, '')) || ',"reason":' || to_json(coalesce(reason, '')) || ',"rank":' || tier || '}', ',' ORDER BY created_at NULLS FIRST, id) || ']' AS j FROM r GROUP BY section_id),
q AS (SELECT section_id, questions[1] AS hint, row_number() OVER (PARTITION BY section_id ORDER BY tier, created_at NULLS LAST, id) AS k FROM r WHERE len(questions) > 0),
h AS (SELECT section_id, string_agg(hint, '|' ORDER BY k) AS hints FROM q WHERE k <= 2 GROUP BY section_id)
SELECT section_id, extraction_status, CAST(coalesce(n, 0) AS INT) AS n_facts, coalesce(j, '[]') AS facts, coalesce(hints, '') AS hints FROM s LEFT JOIN g USING (section_id) LEFT JOIN h USING (section_id)""",
    "job_messages": """SELECT DISTINCT ON (id) id, '{"id":"' || id || '"' || coalesce(',"section_id":"' || section_id || '"', '') || CASE WHEN attempt_number > 1 THEN ',"attempt":' || attempt_number ELSE '' END || '}' AS message FROM summaries WHERE id IS NOT NULL""",
    "vector_search": "WITH q AS (SELECT list_transform(range(0, 64), lambda k: ((7 * k) % 13) / 13.0 - 0.5) AS q) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2)), 6) AS distance FROM embeddings, q WHERE label = 3 AND embedding IS NOT NULL ORDER BY list_sum(list_transform(list_zip(embedding, q), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2)), vec_id LIMIT 5",
    "vector_neighbours": "SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS d, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)), b.vec_id) AS INT) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5",
    "job_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "order_rollup": "SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
    "top_orders": "SELECT c_mktsegment, rank, o_orderkey, o_totalprice FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01') GROUP BY c_mktsegment",
}
