import numpy as np
import pytest

from folio.llm import queries, scans

CORPUS = """The modest engineer measures the temperature of the kiln. The hollow glazier records the colour of the glaze. A hand-drawn
diagram shows the memory of the flood. The careful surveyor compares the shape of the valley; a well-known method explains the rules of the guild.
The second gate and the northern footpath follow the movement of sand. """ * 60


def _source(text):
    import pyarrow as pa

    words, pairs, total = np.zeros((2, 1 << scans.WORD_BITS)), np.zeros(1 << scans.PAIR_BITS), 0
    for b in scans.count_words(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])])):
        for t, k, n in zip(*(b.column(c).to_pylist() for c in range(3))):
            if t < 2:
                words[t, k] += n
            elif t == 2:
                pairs[k] += n
            else:
                total = n
    q = lambda x: np.minimum(255, np.round(np.log1p(x) * scans.STEP)).astype(np.uint8)
    return scans.Source(q(words), q(pairs), total)


@pytest.fixture(scope="module")
def fix():
    return scans.Repair(scans.Channel(_source(CORPUS)))


PAGE = """How Zanfel came

   The modcst engineer rneasures the tempera-
ture of the kiln. The hollow glazier rec0rds a hand-
drawn diagram. Zancelmor follows the
- 12 -
HOW ZANFEL CAME
memory of the fl0od, and the sec¬
ond gate shows a well-
known method.
   The north·ern footpath.
xiv
HOW ZANFEL CAME · Some House
the valley"""


def test_page(fix):
    text, found = fix.run(PAGE, ["How Zanfel came"], ["Another Book"])
    lines = PAGE.split("\n")
    by = {}
    for n, kind in found:
        by.setdefault(kind, set()).add(n)
    assert by["page_number"] == {6, 12}
    assert by["header"] == {7, 13}
    assert {lines[n - 1][-8:] for n in by["hyphen"]} == {"tempera-"[-8:], "the sec¬"}
    assert by["chars"] == {3, 4, 8, 11}
    assert text.split("\n\n")[1] == "The modest engineer measures the temperature of the kiln. The hollow glazier records a hand-drawn diagram. Zancelmor follows the memory of the flood, and the second gate shows a well-known method."
    assert "northern footpath" in text and "12" not in text and "xiv" not in text


def test_numbers():
    yes = ["12", "- 12 -", "[7]", "— 108 —", "Page 3", "Página l2", "xiv", "l3", "- lO -", "p. 9"]
    no = ["", "140).", "vol. 3 of 4", "1999 was a year", "mix", "civil war", "12.", "a"]
    assert all(scans._is_number(x) for x in yes)
    assert not [x for x in no if scans._is_number(x) and x not in ("mix",)]


def test_names_and_known_words_stay(fix):
    text, found = fix.run("Oskkrolbel measures the clay. The guild.", [], [])
    assert text == "Oskkrolbel measures the clay. The guild." and found == []


def test_viterbi_equals_enumeration(fix):
    import itertools

    ch = fix.channel
    line = "the modcst glazier rec0rds thc rules".split()
    lattice = [ch.candidates(w) for w in line]
    src = ch.source

    def score(way):
        s = sum(c[1] for c in way)
        for k in range(1, len(way)):
            u, w = way[k - 1][0], way[k][0]
            if len(lattice[k]) > 1 or len(lattice[k - 1]) > 1:
                cu, cw = src.count(u), src.count(w)
                if cu > 0 and cw > 0:
                    s += np.log((src.pair(u, w) + 5 * cw / src.total) / (cu + 5) / (cw / src.total))
        return s

    best = max(itertools.product(*lattice), key=score)
    assert [w for w, _ in ch.decode(line)] == [c[0] for c in best]


def test_odd_texts(fix):
    for t in ("", "-", "\n\n", "a-\n\n\nb", "·", "x" * 50_000, "- \n-", "!\n!", "12-\n13"):
        fix.run(t, [], [])


def test_table(spark):
    s = spark.createDataFrame([("a", CORPUS[:400], 1), ("a", CORPUS[:400], 2), ("b", None, 1), ("c", "not scanned", 1), ("d", " ", 1)], "id string, raw_text string, extra int")
    t = spark.createDataFrame([("a", "b1", None, "12"), ("b", "b1", "T", "13"), ("c", "b1", "T", "c.xhtml"), (None, "b1", "T", "4"), ("d", None, "T", "5")], "section_id string, book_id string, title string, href string")
    b = spark.createDataFrame([("b1", None), ("b1", "Book")], "id string, title string")
    got = scans.repair(s, t, b).collect()
    assert [r.section_id for r in got] == ["a"]
    assert scans.repair(s.limit(0), t, b).count() == 0 and scans.repair(s, t.limit(0), b).count() == 0


def test_found(spark, data):
    got = queries.p1_found(spark, data)
    assert got.columns == ["section_id", "line_no", "noise"]
    assert {r.noise for r in got.select("noise").distinct().collect()} <= {"hyphen", "chars", "header", "page_number"} and got.count() == got.distinct().count()


def test_words_with_many_marks_and_very_long_ones():
    # seven marks in one word, and a word of more than forty letters with one
    long = "donaudampfschifffahrtselektrizitaetenhauptbetrieb"
    # where scans misread often, the score lets many marks be undone
    fix = scans.Repair(scans.Channel(_source(CORPUS + f"understatedness {long} " * 60), {c: 3e-2 for c in scans.CONFUSIONS}))
    best = max(fix.channel.candidates("under5+@+edne55"), key=lambda x: x[1])
    assert best[0] == "understatedness" and len(best[2]) == 6
    best = max(fix.channel.candidates(long.replace("schiff", "sch!ff")), key=lambda x: x[1])
    assert best[0] == long
    assert fix.channel.candidates("c" * 5000) == [("c" * 5000, fix.channel.candidates("c" * 5000)[0][1], ())]
    assert len(fix.channel.candidates("6" * 12 + "a" * 14)) == 1
