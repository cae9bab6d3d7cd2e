import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import session
from folio.operators import html, pdf, toc, vector
from folio.sources import books
from folio.streaming import jobs

NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>
<navPoint><navLabel><text> One </text></navLabel><content src="one_two-x.xhtml#s1"/><navPoint><navLabel><text></text></navLabel><content src="one_two-x.xhtml#s2"/></navPoint></navPoint>
<navPoint><content src=""/></navPoint></navMap></ncx>"""


def _epub(ncx):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="one_two-x.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        if ncx:
            z.writestr("O/toc.ncx", ncx)
        z.writestr("O/one_two-x.xhtml", '<html><body><h1 id="s1">7.1</h1><p>First <b>bold</b>.</p><div><h2 id="s2">7.2</h2><p>Second.</p></div></body></html>')
    return b.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(_epub(NCX))
    (tmp_path / "b.epub").write_bytes(_epub("<broken"))
    (tmp_path / "c.epub").write_bytes(b"no zip")
    got = {r.path.split("/")[-1]: r for r in books.epub_books(books.landing(spark, str(tmp_path))).collect()}
    a = got["a.epub"]
    assert (a.title, a.author) == ("Book", "Me")
    assert [(c.level, c.title, c.href) for c in a.contents] == [(1, "One", "one_two-x.xhtml#s1"), (2, "one two x", "one_two-x.xhtml#s2"), (1, "Untitled", "")]
    assert [c.title for c in got["b.epub"].contents] == ["Full Book"] and got["c.epub"].error
    rows = [(f"{c.toc_order}", "a", c.title, c.level, c.toc_order, c.href, None) for c in a.contents]
    t = spark.createDataFrame(rows, "id string, book_id string, title string, level int, toc_order int, href string, section_id string")
    files = spark.createDataFrame([("a", d.path, d.html) for d in a.documents], "book_id string, path string, html string")
    texts = {r.id: r.markdown for r in html.extract_texts(toc.stop_anchors(t), files).collect()}
    assert texts["1"].startswith("# 7.1\n\nFirst **bold**.") and "7.2" in texts["1"] and texts["2"] == "## 7.2\n\nSecond."


def _md(doc, anchor, stop=None):
    nodes = html.extract(html.parse(doc), anchor, stop)
    return html.to_markdown(nodes) if nodes else nodes


def test_anchor_strategies():
    doc = '<html><body><nav>n</nav><p>Intro</p><section id="a"><h2>A</h2><p>ta</p><section><p>inner</p></section></section><h2 id="h">H</h2><p>th</p><script>x</script><div><p>more</p><p id="stop">z</p></div><p class="chapter"><a name="old"></a>C</p><p>tc</p></body></html>'
    assert _md(doc, None) == "Intro"
    assert _md(doc, "a") == "## A\n\nta"
    assert _md(doc, "h", "stop") == "## H\n\nth\n\nmore"
    assert _md(doc, "old") == "C\n\ntc"
    assert _md(doc, "none") is None
    assert _md("<html><body><p>only</p><section><p>x</p></section></body></html>", None) == "only"


def test_malformed_html():
    assert "two" in html.to_markdown(html.chapter_level(html.parse("<html><body><p>one<p>two<ul><li>a<li>b</ul>")))
    assert html.to_markdown(html.chapter_level(html.parse(""))) == ""


def test_kinds_and_upsert(spark):
    f = spark.createDataFrame([("a.EPUB",), ("b.x.pdf",), ("pdf",), (None,), ("c.txt",)], "source_filename string")
    ok, bad = books.by_kind(f)
    assert sorted(r.kind for r in ok.collect()) == ["epub", "pdf"] and bad.count() == 3
    old = spark.createDataFrame([("1", 1, "a"), ("2", 5, "b")], "id string, created_at int, v string")
    new = spark.createDataFrame([("1", 2, "c"), ("2", 3, "d"), ("3", 1, None), (None, 1, "x")], "id string, created_at int, v string")
    assert {r.id: r.v for r in books.upsert(old, new).collect()} == {"1": "c", "2": "b", "3": None}
    assert {r.id: r.state for r in books.ingest(new, old).collect()} == {"1": "exists", "2": "exists", "3": "new"}


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("b", "x", [1.0])], "book_id string, id string, vector array<float>")
    books.append_vectors(c, str(tmp_path / "v"))
    books.append_vectors(c, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    books.export_markdown(spark.createDataFrame([("b", "s", None)], "book_id string, id string, raw_text string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() > 0
    books.create_tables(spark)
    assert spark.table("default.fact").columns[:3] == ["id", "created_at", "section_id"]


def test_pdf_pages(spark):
    rows = [("d", 1, 0, 0, 0, 10.0, "body"), ("d", 1, 0, 1, 0, 20.0, "Head"), ("d", 1, 0, 2, 0, 12.9, " more "), ("d", 2, 0, 0, 0, 16.0, "ab"), ("d", 2, 1, 0, 0, 13.0, "x" * 99), ("d", 2, 1, 1, 0, 13.0, "y" * 100), ("d", 2, 2, 0, 0, 9.0, " ")]
    s = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, size double, text string")
    assert {r.page: r.markdown for r in pdf.page_markdown(s).collect()}[1] == "# Head\n\nbody more"
    assert [(r.title, r.href) for r in pdf.heuristic_toc(s).orderBy("toc_order").collect()] == [("Introduction", "1"), ("Head", "1"), ("x" * 99, "2")]


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[3]
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in vector.nearest(v, v.where("vec_id % 50 = 0"), 4, block=4).collect()}
    for q in range(0, 300, 50):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        best = [k for k in np.lexsort((np.arange(300), d)) if k != q][:4]
        assert [got[q, n + 1] for n in range(4)] == best
    assert vector.nearest(v.limit(0), v.limit(0)).count() == 0
    assert vector.search(v, [0.0] * 8, F.col("vec_id") < 10, 3).count() == 3
    e = vector.embed(spark.createDataFrame([("a",), (None,), ("ccc",)], "text string"), lambda ts: [[len(t)] for t in ts], 1)
    assert [r.vector for r in e.collect()] == [[1.0], None, [3.0]]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    s = jobs.table_stream(spark, str(tmp_path), df.schema, "*")
    got = jobs.drained(jobs.latest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t.parquet")), "k", "t", "v", "v"), "test_latest")
    assert s.isStreaming and {r.k: r.v for r in got.collect()} == {1: "b", 2: "c"}


def test_vectors_by_book_and_section(spark, tmp_path):
    at = str(tmp_path / "v")
    c = spark.createDataFrame([("1", "a b", "s", [1.0]), ("2", "a b", "t", [2.0]), ("3", "c", "s", [3.0])], "id string, book_id string, section_id string, vector array<float>")
    books.append_vectors(c, at)
    assert [r.id for r in books.vectors(spark, at, "a b").orderBy("id").collect()] == ["1", "2"] and [r.id for r in books.vectors(spark, at, "a b", "t").collect()] == ["2"]
    assert [r.id for r in books.vectors(spark, at, section_id="s").orderBy("id").collect()] == ["1", "3"]
    assert books.delete_vectors(spark, at, "a b") and not books.delete_vectors(spark, at, "zz")
    assert [r.id for r in books.vectors(spark, at).collect()] == ["3"]
    with pytest.raises(Exception, match="no vector"):
        books.append_vectors(spark.createDataFrame([("4", "c", "s", None)], c.schema), at)
    assert vector.of_width(c, "vector", 1).count() == 3
    with pytest.raises(Exception, match="width"):
        vector.of_width(c, "vector", 2).collect()
    assert [r.id for r in books.without_keys(c, spark.createDataFrame([("1",), ("3",)], "id string")).collect()] == ["2"]


def test_many_queries_meet_rows_in_blocks(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(k, [float(rng.randint(0, 3)) for _ in range(4)]) for k in range(150)] + [(900, None), (None, [0.0] * 4)], "vec_id long, embedding array<float>")
    one = sorted(vector.nearest(v, v, 3).collect())
    assert one == sorted(vector.nearest(v, v, 3, block=40, rows_a_block=60).collect()) and len(one) == 450
    assert vector.nearest(v, v.limit(0), 3).count() == 0 and vector.nearest(v.limit(0), v, 3).count() == 0


def test_unzip(spark, tmp_path):
    def book(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, x in files.items():
                z.writestr(n.replace("__", "/"), x)
        return b.getvalue()

    f = spark.createDataFrame([("a", book(O__x="1", y="2")), ("b", b"no archive"), ("c", book(**{"..__out": "3"})), ("../d", book(y="4")), (None, book(y="5"))], "book_id string, content binary")
    for _ in range(2):
        got = {r.book_id: r for r in books.unzip_epubs(f, str(tmp_path)).collect()}
    assert (tmp_path / "a" / "O" / "x").read_text() == "1" and got["a"].n_files == 2 and got["a"].error is None
    assert set(got) == {"a", "b", "c", "../d"} and all(got[k].error and got[k].folder is None for k in ("b", "c", "../d")) and os.listdir(tmp_path) == ["a"]


def test_stored_tables_are_cleared(spark):
    session.clear(spark)
    one = session.stored(spark.range(3))
    assert one.count() == 3 and session.clear(spark) == 1 and session.clear(spark) == 0
    with pytest.raises(Exception):
        one.count()
