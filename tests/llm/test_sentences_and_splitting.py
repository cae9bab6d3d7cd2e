import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.llm import queries, sentences, splitting
from folio.session import table


@pytest.fixture(scope="module")
def model(spark, data):
    return sentences.fit(table(spark, data, "sections"))


def _cut(model, text):
    return [text[a:b] for a, b in model.spans(text)]


CASES = [
    ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
    ("It costs 3.50 now. See Fig. 3 and p. 4 for more. Good!", ["It costs 3.50 now.", "See Fig. 3 and p. 4 for more.", "Good!"]),
    ('"Who goes there?" asked the guard. Nobody answered.', ['"Who goes there?" asked the guard.', "Nobody answered."]),
    ("She wrote: “It rains. It pours.” Nobody came.", ["She wrote: “It rains. It pours.”", "Nobody came."]),
    ("They stayed (the reason is below. It is brief.) for long. Then they left.", ["They stayed (the reason is below. It is brief.) for long.", "Then they left."]),
    ("A title\n\nOne line\nand its end.\n \nNext", ["A title", "One line\nand its end.", "Next"]),
    ("The first gate was closed.The second one was open.", ["The first gate was closed.", "The second one was open."]),
    ("The file a.v3.txt is old; the rest is new. Yes.", ["The file a.v3.txt is old; the rest is new.", "Yes."]),
    ("我来了。你走了！为什么？", ["我来了。", "你走了！", "为什么？"]),
    ("* * *\n\n123", []),
    ("«Qué dices?», preguntó el maestro. Nada.", ["«Qué dices?», preguntó el maestro.", "Nada."]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_cases(model, text, expected):
    assert _cut(model, text) == expected


def test_unclosed_marks(model):
    assert len(_cut(model, "He said “no and left. She stayed there.")) == 2
    assert _cut(model, "") == [] and _cut(model, " \n\n \t") == []


def test_posteriors_agree_with_enumeration(model):
    # all ways to set the boundaries of a paragraph, weighed one by one
    text = "“The gate is open.” said Wolf. Dr. Low wrote: “Yes. No.” We left. 7 a.m. came, etc. They saw."
    (p,) = list(sentences.paragraphs(text, model.steps))
    n = len(p.gaps)
    total, at = 0.0, [0.0] * n
    for way in range(1 << n):
        w, before = 1.0, 1
        for k, (_, left0, left1, right, _) in enumerate(p.gaps):
            b, c = model.scores(left1 if before else left0, right)
            before = way >> k & 1
            w *= b if before else c
        total += w
        for k in range(n):
            at[k] += w * (way >> k & 1)
    assert n > 3 and all(abs(q - a / total) < 1e-9 for q, a in zip(model.posteriors(p), at))


def test_tables(spark, model):
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 2), ("b", None, 1), ("c", " \n", 1), (None, "x.", 1), ("d", "Long text without end " * 500, 1)]
    s = spark.createDataFrame(rows, "id string, raw_text string, sentence_no int")
    got = sentences.sentences(s, model=model)
    assert {(r.section_id, r.sentence_no, r.start_char, r.end_char) for r in got.where("section_id = 'a'").collect()} == {("a", 1, 0, 4), ("a", 2, 5, 9)}
    assert {r.section_id for r in got.collect()} == {"a", "d"}
    assert sentences.sentences(s.limit(0)).count() == 0


def test_found_is_well_formed(spark, data):
    got = queries.p2_found(spark, data)
    assert got.columns == ["section_id", "sentence_no", "start_char", "end_char"]
    s = table(spark, data, "sections").select(F.col("id").alias("section_id"), "raw_text").dropDuplicates(["section_id"])
    t = got.join(s, "section_id").withColumn("t", F.expr("substring(raw_text, start_char + 1, end_char - start_char)"))
    assert t.where("t rlike '^\\\\s|\\\\s$' or not t rlike '\\\\p{L}'").count() == 0
    assert got.groupBy("section_id").agg((F.max("sentence_no") - F.count("*")).alias("d")).where("d <> 0").count() == 0


def _coarsest(text, limit, model):
    # the definition, without a recursion
    if len(text) <= limit:
        return "section"
    blocks = re.split(r"\n\s*\n", text)
    return next((n for n, units in (("paragraph", [len(x.strip()) for x in blocks]), ("sentence", [b - a for a, b in model.spans(text)]), ("word", [len(x) for x in text.split()])) if all(x <= limit for x in units)), "character")


def test_pieces(model):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Sentence ends. ", "\n\n", "x" * rng.randint(1, 90), "\n", "  ", "。", "é"]) for _ in range(rng.randint(1, 120)))
        for limit, overlap in ((60, 12), (30, 0), (9, 4)):
            boundary, got = splitting.split_text(text, limit, overlap, model)
            assert boundary == _coarsest(text, limit, model)
            assert all(0 < b - a <= limit for a, b, _ in got)
            assert all(o == overlap for _, _, o in got[1:])
            assert "".join(text[a + o : b] for a, b, o in got) == text.strip()


def test_pieces_end_at_natural_boundaries(model):
    text = "First paragraph here.\n\nSecond one is longer. It has two sentences.\n\nThird."
    got = [text[a:b] for a, b, _ in splitting.split_text(text, 45, 0, model)[1]]
    assert got == ["First paragraph here.", "\n\nSecond one is longer. It has two sentences.", "\n\nThird."] or got[0] == "First paragraph here."
    for limit, boundary in ((100, "section"), (45, "paragraph"), (25, "sentence"), (10, "word"), (4, "character")):
        assert splitting.split_text(text, limit, 2, model)[0] == boundary
    stars = "One is here.\n\n" + "* " * 40
    assert splitting.split_text(stars, 30, 0, model)[0] == _coarsest(stars, 30, model) == "sentence"


def test_split_table(spark, model):
    s = spark.createDataFrame([("a", "w " * 40, 1), ("a", "w " * 40, 2), ("b", None, 1), ("c", "short", 1)], "id string, raw_text string, piece_no int")
    got = splitting.split(s, 20, 5, model)
    assert got.where("section_id = 'c'").first().boundary == "section"
    assert got.where("section_id = 'a'").count() > 3 and got.groupBy("section_id", "piece_no").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        splitting.split(s, 5, 5, model)


def _none():
    return iter([pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"])])


def test_counting_needs_no_rows():
    assert sum(b.num_rows for b in sentences.count_words(_none())) == 0
    empty = np.zeros(0, np.int64)
    words = sentences.Words.of(empty, empty, empty, empty, empty)
    assert sum(b.num_rows for b in sentences.count_gaps(_none(), words)) == 0
    m = sentences.Model(np.zeros((0, 6), np.int64), words)
    assert _cut(m, "We came. They left.") == ["We came.", "They left."]


def test_buckets_of_words_in_texts():
    text = "The Gate, the Été;  a.b c: d. größe \n ende"
    want = [sentences.bare_bucket(w) for w in ("the", "gate", "the", "été", "b", "c", "größe")]
    assert sentences.bare_buckets(text).tolist() == want and len(sentences.bare_buckets("")) == 0


def test_abbreviations_are_learned_by_what_is_around_them(spark):
    # no list names these; they are told by their shape and by the words behind them
    rng = random.Random(3)
    names = ["".join(rng.choice(("ha", "lo", "ri", "men", "tas", "vu", "kor")) for _ in range(3)).capitalize() for _ in range(400)]
    nouns, verbs, ranks = "gate river barn clock letter field mill road".split(), "saw left found kept sold drew".split(), ["Insp", "Adm", "Supt", "Dir"]

    def sentence():
        who = f"{rng.choice(ranks)}. {rng.choice(names)}" if rng.random() < 0.2 else rng.choice(("The keeper", "The old man", rng.choice(names), "Nobody", "Then a clerk", "In spring they"))
        return f"{who} {rng.choice(verbs)} the {rng.choice(nouns)} near {rng.choice(names)} and the {rng.choice(nouns)}."

    rows = [(str(k), " ".join(sentence() for _ in range(6))) for k in range(300)]
    m = sentences.fit(spark.createDataFrame(rows, "id string, raw_text string"))
    assert sum(len(m.spans(t)) == 6 for _, t in rows) > 285
    for rank in ranks + ["Cmdr"]:
        assert _cut(m, f"The keeper saw the gate. {rank}. {names[3]} kept the clock. The old man left the mill.") == ["The keeper saw the gate.", f"{rank}. {names[3]} kept the clock.", "The old man left the mill."], rank


def test_numerals(spark, data):
    model = sentences.fit(table(spark, data.replace("sf0.001", "sf0.1"), "sections"))
    # a Thai space beside a numeral parts no sentences, an Arabic number may end one
    assert len(_cut(model, "นักเขียนปกป้องกฎของสมาคมหนัก 58.70 กิโลกรัม พ่อค้าบรรยายตัวอย่างน้ำ")) == 2
    assert _cut(model, "Am 14. Mai kopiert der Weber die Karte. Der Turm steht.") == ["Am 14. Mai kopiert der Weber die Karte.", "Der Turm steht."]


SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
SHORT, LAST = (["".join(x) for x in itertools.product(p, q, "bt", "xz")] for p, q in (("BDGK", "dkg"), ("ZV", "oua")))


@pytest.fixture
def crowded(spark, monkeypatch):
    """Texts of 4,000 words at the ends of sentences, six times each, of rarer abbreviations before names, and of as rare words at ends."""
    monkeypatch.setattr(sentences, "MOST_LEFTS", 3000, raising=False)  # the limit there once was, of 200,000; to reach that takes a large table
    rng = random.Random(5)
    words = 6 * ["".join(x) for x in itertools.islice(itertools.product(SYLLABLES, repeat=3), 4000)]
    rng.shuffle(words)
    names = ["".join(rng.choice(SYLLABLES) for _ in range(3)).capitalize() for _ in range(60)]
    said = [f"{rng.choice(('We', 'Nobody', 'The clerk', 'She'))} saw the gate near {rng.choice(names)} and {w}." for w in words]
    rows = [(f"p{k}", "\n\n".join(" ".join(said[j : j + 6]) for j in range(k, k + 60, 6))) for k in range(0, len(said), 60)]
    rows += [(f"{a}{k}", f"The old keeper of the northern gate near the mill and {a}. {rng.choice(names)} saw the river near the road and the clerk.") for a in SHORT for k in range(5)]
    rows += [(f"{a}{k}", f"We saw the gate. The clerk saw the {a.lower()}.") for a in LAST for k in range(5)]
    return spark.createDataFrame(rows, "id string, raw_text string")


def test_rare_tokens_among_many_have_chances_of_their_own(crowded):
    # p2: of tokens beyond the most frequent ones all counts were once left out, so that those of one shape were all the same
    m = sentences.fit(crowded)

    def odds(word):
        b, c = m.scores("L." + word.lower(), ("L", sentences.CAPITAL))
        return b / c

    assert max(map(odds, SHORT)) * 10 < min(map(odds, LAST))
    assert all(len(m.spans(r.raw_text)) == 1 + (r.id[0] in "ZV") for r in crowded.where("not id like 'p%'").collect())


def test_tokens_seen_alike_are_fitted_as_each_would_be(spark, data):
    s = table(spark, data, "sections")
    m = sentences.fit(s)
    batch = sentences.texts(s).select("raw_text").toArrow().to_batches()
    counts = pa.Table.from_batches(list(sentences.count_gaps(iter(batch), m.words))).group_by(["kind", "s", "q", "l", "r"]).aggregate([("n", "sum")])
    each = sentences.Model(np.column_stack([c.to_numpy() for c in counts.columns]), m.words)
    assert len(m.lefts) == len(each.lefts) > len(m.e) and len(each.e) == len(each.lefts)
    assert (m.lefts == each.lefts).all() and np.allclose(m.e[m.places], each.e[each.places], atol=1e-5)
    texts = sentences.texts(s).dropDuplicates(["section_id"]).collect()
    assert all(m.spans(r.raw_text) == each.spans(r.raw_text) for r in texts)


def test_counts_of_words_are_whole(spark):
    # counts beyond 32 bits once ended there
    n = 3 * 2**31
    rows = [(0, 7, n, n, 0), (-1, 7, 0, 0, n), (0, 9, n // 6, n, 0)]
    many = spark.createDataFrame(rows, "g byte, b int, start long, inside long, bare long")
    got = sentences.words_of(many)
    cols = (np.array(c) for c in zip(*((b, g, x, y, z) for g, b, x, y, z in rows)))
    want = sentences.Words.of(*cols)
    assert (got.steps == want.steps).all() and (got.bare == want.bare).all() and got.bare[7] == 33


def test_pieces_are_cut_by_the_chances_of_all_tokens(crowded, monkeypatch):
    # p3 fits the model itself; of tokens beyond the most frequent ones all counts were once left out there, too
    made = []
    monkeypatch.setattr(splitting, "fit", lambda s: made.append(sentences.fit(s)) or made[-1])
    toc = crowded.where("not id like 'p%'").select(F.col("id").alias("section_id"), F.lit("a.xhtml").alias("href"))
    got = splitting.oversized(crowded, toc, 80, 10).collect()
    assert len(got) == 5 * len(SHORT) and {r.boundary for r in got} == {"word"}
    odds = [[b / c for b, c in (made[0].scores("L." + w.lower(), ("L", sentences.CAPITAL)) for w in some)] for some in (SHORT, LAST)]
    assert max(odds[0]) * 10 < min(odds[1])


#: Words that openers once shared a bucket of 20 bits with, and abbreviations that so did with words without a full stop.
SHARED = {"She": "Bagipeka Bidogoto Mofipefe Morusemi", "Nobody": "Bekerafu Legafobi Murolaga Reluredi", "Then": "Dofurenu Feseraku Fogenato Folusapa", "They": "Doralase Dotilese Gumedeta Kenidulo"}
SHARED_BARE = {"uyr": "of", "tvhj": "gate", "wlny": "clerk", "axiq": "to"}


def test_pieces_are_cut_by_each_word_alone(spark):
    # p3: words in one bucket were once told apart no further, so that a name was taken for what opens sentences, or an abbreviation for a word
    rng = random.Random(6)
    names = " ".join(SHARED.values()).split() + ["".join(rng.choice(SYLLABLES) for _ in range(3)).capitalize() for _ in range(80)]
    rows = [(f"p{k}", "\n\n".join(f"{rng.choice(list(SHARED))} saw the gate near {rng.choice(names)} and went to the clerk of {rng.choice(names)}." for _ in range(6))) for k in range(80)]
    head = "The old keeper of the northern gate near the mill and the clerk of"
    rows += [(f"w{k}", f"{head} no. {w} saw the river and the road.") for k, w in enumerate(names)]
    rows += [(f"s{k}", f"{head} no. {w} saw the river and the road.") for k, w in enumerate(25 * list(SHARED))]
    rows += [(f"w{a}{k}", f"{head} {a}. {rng.choice(names)} saw the river and the road.") for a in SHARED_BARE for k in range(5)]
    s = spark.createDataFrame(rows, "id string, raw_text string")
    toc = s.where("not id like 'p%'").select(F.col("id").alias("section_id"), F.lit("a.xhtml").alias("href"))
    got = splitting.oversized(s, toc, 80, 10).collect()
    assert len(got) == len(names) + 100 + 20
    assert [r for r in got if r.boundary != {"w": "word", "s": "sentence"}[r.section_id[0]]] == []
    words = sentences.word_steps(sentences.texts(s))
    assert all(sentences._bare("L." + a, words) == 0 < sentences._bare("L." + b, words) for a, b in SHARED_BARE.items())


def test_counts_of_bare_words_are_summed_in_parts():
    texts = [" ".join(a + b + c + d for b in SYLLABLES for c in SYLLABLES for d in SYLLABLES[:6]) + " gate " for a in SYLLABLES]
    parts = list(sentences.count_words(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["t"]) for t in texts])))
    rows = [(g, b, n) for p in parts for g, b, n in zip(*(p.column(k).to_pylist() for k in (0, 1, 4)))]
    assert len(parts) > 2 and sum(n for _, _, n in rows) == 60 * (60 * 60 * 6 + 1) and len({b for _, b, _ in rows}) == 60 * 60 * 60 * 6 + 1
    assert sum(n for _, b, n in rows if b == sentences.bare_bucket("gate")) == 60
