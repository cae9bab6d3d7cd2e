import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.plans import pipeline, views

NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="a.xhtml#p"/>
<navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#s1"/></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="a.xhtml#s2"/></navPoint></navPoint></navMap></ncx>"""


def _epub(title):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", f'<package xmlns:dc="d"><metadata><dc:title>{title}</dc:title></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("toc.ncx", NCX)
        z.writestr("a.xhtml", '<html><body><h1 id="p">Part</h1><h2 id="s1">One</h2><p>First text here.</p><h2 id="s2">Two</h2><p>Second text.</p></body></html>')
    return b.getvalue()


@pytest.fixture(scope="module")
def loaded(spark):
    f = spark.createDataFrame([("/in/x.epub", _epub("X")), ("/in/copy.EPUB", _epub("X")), ("/in/y.epub", _epub("Y")), ("/in/z.epub", b"broken"), ("/in/s.pdf", b"p"), ("/in/n.txt", b"t")], "path string, content binary")
    return pipeline.load(f)


def test_load(spark, loaded):
    b = loaded["books"].collect()
    assert sorted(r.title for r in b) == ["X", "Y"] and {r.state for r in b} == {"new"} and {r.source_format for r in b} == {"epub"}
    assert {r.path: r.reason for r in loaded["rejected"].collect()} == {"/in/s.pdf": "no loader for pdf", "/in/n.txt": "unknown kind"}
    assert [r.path for r in loaded["failed"].collect()] == ["/in/z.epub"]
    assert loaded["toc"].count() == 6 and loaded["sections"].count() == 6
    assert {r.raw_text for r in loaded["sections"].collect()} >= {"## One\n\nFirst text here.", "## Two\n\nSecond text."}
    again = pipeline.load(spark.createDataFrame([("/other/x.epub", _epub("X"))], "path string, content binary"), loaded["books"].select("id"))
    assert [r.state for r in again["books"].collect()] == ["exists"]


def test_chunks_and_vectors(spark, loaded, tmp_path):
    c = pipeline.chunked(loaded["sections"], loaded["toc"], loaded["books"]).cache()
    heads = {r.text.split("\n")[0] for r in c.collect()}
    assert "[X > Part > One]" in heads and "[Y > Part]" in heads and c.where("book_id IS NULL").count() == 0
    store = pipeline.ParquetVectors(spark, str(tmp_path / "v"))
    store.append(pipeline.embedded(c, lambda texts: [[float(len(t)), 1.0] for t in texts], 2))
    book = c.first().book_id
    assert store.read().count() == c.count() and store.read(book).count() * 2 == c.count()
    (near,) = store.search([1e6, 1.0], F.col("book_id") == book, 1).collect()
    assert near.id in {r.id for r in store.read(book).collect()} and store.delete(book) and store.read(book).count() == 0


def test_facts_of_a_model(spark, loaded):
    c = pipeline.chunked(loaded["sections"], loaded["toc"], loaded["books"])
    have = spark.createDataFrame([], "chunk_id string")

    def call(system, user):
        if "Second" in user:
            raise OSError("down")
        return json.dumps([{"point": "p", "rank": 1, "start_char": 0, "end_char": 3}]) if "First" in user else "{}"

    got = pipeline.extract_facts(c, have, call)
    assert got["facts"].count() >= 2 and {r.point for r in got["facts"].collect()} == {"p"} and got["failed"].count() >= 2
    assert {r.status for r in got["status"].collect()} == {"DONE", "ERROR"}
    assert pipeline.extract_facts(c, got["facts"], call)["facts"].count() == 0


def test_evaluation(spark):
    long = "word " * 60
    sections = spark.createDataFrame([("s", "DONE", 1)], "id string, extraction_status string, created_at int")
    known = spark.createDataFrame([("f1", "s", 1, "p1", None), ("f2", "s", 3, "p2", None)], "id string, section_id string, rank int, point string, created_at timestamp")
    m = spark.createDataFrame([("m1", "s", long, 1), ("m2", "s", long, 2), ("m3", "s", "short", 3)], "id string, section_id string, text string, submitted_at int")
    old = spark.createDataFrame([("r1", "m1", 20.0)], "report_id string, summary_id string, score double")
    v = spark.createDataFrame([("r1", "f1", "missing")], "report_id string, atomic_fact_id string, status string")
    asked = []

    def call(system, user):
        assert "Attempt 1 scored 20" in user and "Missing       f1" in user
        return '```json\n[{"fact_id": "f1", "status": "FOUND", "confidence": 1}, {"fact_id": "f2", "status": "missing", "confidence": 1}]\n```'

    got = pipeline.evaluate(m, sections, known, old, v, call)
    (r,) = got["reports"].collect()
    assert r.summary_id == "m2" and r.attempt == 2 and abs(r.score - 25.0) < 1e-9 and abs(r.score_delta - 5.0) < 1e-9
    assert {(x.atomic_fact_id, x.status) for x in got["feedback"].collect()} == {("f1", "found"), ("f2", "missing")}
    assert {x.id: x.reason for x in got["rejected"].collect()} == {"m3": "too short"} and not asked


def test_views(spark, loaded):
    b = spark.createDataFrame([("1", "A", None, "pdf", 2), ("1", "A", None, "pdf", 2), ("2", "B", "Me", "epub", 5), (None, "C", None, None, 1)], "id string, title string, author string, source_format string, created_at int")
    assert [r.id for r in views.book_list(b).collect()] == ["2", "1"]
    book = loaded["books"].withColumn("created_at", F.lit(1))
    one = views.book_detail(book, loaded["toc"], book.first().id)
    assert one["file_url"].startswith("/books/") and [c["title"] for c in one["toc"]["children"]] == ["Part"] and [c["title"] for c in one["toc"]["children"][0]["children"]] == ["One", "Two"]
    assert views.book_detail(book, loaded["toc"], "none") is None
    assert views.job_messages(b.where("id = '1'"), "id").first().message == '{"id":"1","title":"A","source_format":"pdf","created_at":2}'
