import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, packing, queries, sizes, spam
from folio.session import table


def test_breeding_keeps_all_items_and_capacity():
    rng = random.Random(1)
    size = [rng.randint(1, 99) for _ in range(300)]
    bins = packing.breed(size, 100, 3, 4, 20, [])
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(size[i] for i in b) <= 100 for b in bins)
    first = []
    packing._best_fit(first, [], list(range(300)), size, 100)
    assert len(bins) <= len(first) and -(-sum(size) // 100) <= len(bins)


def test_breeding_saves_bins_of_best_fit():
    saved = 0
    for low, high, capacity, n in ((200, 450, 1000, 300), (150, 350, 1000, 400), (250, 500, 1000, 300), (20, 100, 150, 250)):
        rng = random.Random(11)
        size = [rng.randint(low, high) for _ in range(n)]
        first: list = []
        packing._best_fit(first, [], list(range(n)), size, capacity)
        bins = packing.breed(size, capacity, 5, 6, 300, [])
        assert packing.bound(size, capacity) <= len(bins) <= len(first)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(size[i] for i in b) <= capacity for b in bins)
        saved += len(first) - len(bins)
    assert saved >= 10


def test_bound():
    assert packing.bound([60, 60, 60, 40, 40, 40], 100) == 3 and packing.bound([51] * 7, 100) == 7 and packing.bound([], 10) == 0
    assert packing.bound([60, 60, 30, 30, 30], 100) == 3 and packing.bound([70, 70, 70, 40, 40], 100) == 4


def test_exchange_keeps_items_and_fills_better():
    rng = random.Random(4)
    size = [rng.randint(5, 60) for _ in range(120)]
    bins: list = []
    packing._best_fit(bins, [], list(range(90)), size, 100)
    loads = [sum(size[i] for i in b) for b in bins]
    before, loose = sum(loads), list(range(90, 120))
    left = packing.exchange(bins, loads, loose, size, 100, list(range(len(bins))))
    assert sorted(left + [i for b in bins for i in b]) == list(range(120)) and sum(loads) > before
    assert loads == [sum(size[i] for i in b) for b in bins] and max(loads) <= 100


def test_crossover_injects_whole_bins():
    rng = random.Random(5)
    size = [50] * 20
    a = [(k, k + 1) for k in range(0, 20, 2)]
    b = [(k, 19 - k) for k in range(10)]
    child, loads = packing.crossover((a, [100] * 10), (b, [100] * 10), size, 100, rng)
    assert loads == [100] * 10
    assert sorted(i for x in child for i in x) == list(range(20)) and any(x in b for x in child)


def test_pack(spark):
    rows = [(k, 1 + (k * 37) % 90) for k in range(500)] + [(900, 250), (901, 100), (902, 0), (None, 5), (903, None), (900, 250)]
    s = spark.createDataFrame(rows, "doc_id long, tokens int")
    p = spark.createDataFrame([("a", 100), ("b", 1000), (None, 5), ("n", None)], "pack_name string, capacity_tokens int")
    got = packing.pack(s, p, block=100).collect()
    for name, cap in (("a", 100), ("b", 1000)):
        mine = [r for r in got if r.pack_name == name]
        load, docs = Counter(), defaultdict(list)
        for r in mine:
            load[r.bin_id] += r.tokens
            docs[r.doc_id].append((r.part, r.tokens))
        assert max(load.values()) <= cap and set(docs) == {*range(500), 900, 901}
        assert sorted(docs[900]) == ([(0, 100), (1, 100), (2, 50)] if cap == 100 else [(0, 250)])
        assert sum(load.values()) / (cap * len(load)) > 0.95
    assert packing.pack(s.limit(0), p).count() == 0
    rep = {r.pack_name: r.bins for r in packing.report(packing.pack(s, p), p).collect()}
    assert rep["n"] == 0 and rep["a"] > rep["b"]


def test_split_tree_is_exact():
    q = np.array([100, 7, 0, 33])
    m = mixing.split_tree(q, 7, np.random.default_rng(1))
    assert (m.sum(0) == q).all() and (m >= 0).all() and m.sum(1).max() - m.sum(1).min() <= 3


def test_mix(spark):
    rows = [(k, "Big", 100) for k in range(400)] + [(1000 + k, " small-one ", 100) for k in range(10)] + [(2000, None, 5), (None, "big", 5), (2001, "other", 5), (0, "Big", 100)]
    s = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    t = spark.createDataFrame([("big", 0.75, 1), ("small_one", 0.2, 6), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.mix(s, t, shards=20_000_001)
    assert mixing.mix(s, t).select("shard").distinct().count() <= 16
    m = mixing.mix(s, t, shards=4).collect()
    use = Counter(r.doc_id for r in m)
    assert len({(r.doc_id, r.copy) for r in m}) == len(m)
    assert max(n for d, n in use.items() if d < 1000) == 1 and max(n for d, n in use.items() if d >= 1000) <= 6
    got = {r.source: r for r in mixing.shares(mixing.mix(s, t, shards=4), t).collect()}
    assert abs(got["big"].actual_share - 0.75 / 0.95) < 0.01 and abs(got["small_one"].actual_share - 0.2 / 0.95) < 0.01 and got["none"].tokens == 0
    for n in range(4):
        at = sorted(r.position for r in m if r.shard == n)
        assert at == list(range(len(at)))
    assert mixing.mix(s.limit(0), t).count() == 0 and mixing.mix(s, t.limit(0)).count() == 0


def test_sizes(spark):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "a", "b")], "doc_id long, text string, tokens string").drop("tokens")
    assert {r.doc_id: r.tokens for r in sizes.token_counts(d).collect()} == {1: 2, 2: 0, 3: 0}


PROSE = "The hollow glazier follows the price of barley near the old weir. Nobody in the village had seen such a thing before, and the council met twice that week. "
MORE = "Rain kept most people indoors until Friday, when two carts of timber arrived from the coast. Her brother, who mended clocks, asked whether anyone knew the road through the marsh. No letter came. "
SPAM = {
    "keywords": "cheap books | free ebook | cheap books | used books | free ebook | cheap books | cheap books",
    "newlines": "\n".join(["free ebook", "cheap books", "free ebook", "used books", "free ebook"] * 4),
    "tags": "\n".join(f"{k}: {v}" for k, v in zip(["Tag", "Price", "SKU", "Tag", "Price", "Tag"] * 4, ["free ebook", "12", "99", "cheap books", "7", "read online"] * 4)),
    "links": "\n".join(f"https://a{k}.example/b/{k}" for k in range(12)),
    "markdown": "\n".join(f"[Title number {k} of many](https://a.example/{k})" for k in range(12)),
    "hashtags": "#free #ebook #free #cheap #books #free #cheap #ebook",
    "stuffed": "Find cheap books and free ebooks here, because cheap books means free ebooks and more cheap books. If you want cheap books, our cheap books page has cheap books every day. Looking for cheap books? We have cheap books and more cheap books.",
    "hidden": " / ".join("c.h.e.a.p.b.o.o.k.s" for _ in range(8)),
}
PLAIN = {
    "prose": PROSE + MORE,
    "index": "\n".join(f"word{chr(97 + k)}, {k}, {k + 7}, {k + 30}" for k in range(26)),
    "contents": "\n".join(f"{k}. Chapter {k} .... {k * 9}" for k in range(30)),
    "works": "\n".join(f"Name{k}, L. (19{k}). The gate at Nev{k}. Some House. https://a{k}.example" for k in range(10, 30)),
    "verse": "\n".join(["at low tide,", "the ferryman copies a list of tides;", "the council divides the second gate,", "the carpenter repairs the valley.", ""] * 4),
    "tagged": PROSE + MORE + "\n#one #two #three\nhttps://a.example",
    "hindi": "पहरेदार रेत की चाल सुधारता है। चक्की वाला दूसरी फसल के बाद आधा खाली पीपा पार करता है, पर राजमिस्त्री जौ का भाव छोड़ देता है।",
}


@pytest.mark.parametrize("name", sorted(SPAM))
def test_spam_lines(name):
    assert spam.page(SPAM[name])[1] > 0.5


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_plain_lines(name):
    assert spam.page(PLAIN[name])[1] < 0.5


def test_very_long_line_and_script_of_whole_text():
    assert spam._stuffed(["cheap", "books"] * 49_500) and spam._stuffed(["cheap", "books"] * 50_500)
    assert not spam._stuffed([f"w{k}" for k in range(101_000)])
    head = "The gate. " * 50
    assert spam._script(head + "पहरेदार रेत की चाल सुधारता है। " * 60) == "hi" and spam._script(head) == "la"
    assert spam._script("山川" * 1200 + "ひらがなとカタカナ" * 100) == "ja" and spam._script("山川" * 1200) == "zh" and spam._script("...") == "la"


def test_spam_pages(spark):
    rows = [(k, (PROSE, MORE, PROSE + MORE)[k % 3], "en") for k in range(60)] + [(100 + k, t, None) for k, t in enumerate(SPAM.values())] + [(200, None, "en"), (201, " ", "en"), (None, "x", "en"), (202, "...", "en")]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, share double")
    got = {r.doc_id for r in spam.spam_pages(d).collect()}
    assert got == {100 + k for k in range(len(SPAM))}
    assert spam.spam_pages(d.limit(0)).count() == 0


def test_spam_and_copies_are_most_of_their_group(spark):
    rng = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]

    def prose():
        return " ".join(f"{' '.join(rng.sample(words, 9)).capitalize()}." for _ in range(4))

    def stuffed(a, b):
        return SPAM["stuffed"].replace("cheap", a).replace("free", b)

    copies = [(k, SPAM["stuffed"], "en") for k in range(40)]
    few = copies + [(100 + k, prose(), "en") for k in range(5)]
    much = copies + [(100 + k, prose(), "en") for k in range(30)]
    several = [(k, stuffed(f"a{k}", f"b{k}"), "en") for k in range(40)] + much[40:]
    for rows in (few, much, several):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = spam.spam_pages(d).collect()
        assert {r.doc_id for r in got} == set(range(40))
    # it is the curve that finds them: without extremes there is no spam, whatever the lines say
    assert spam.spam_pages(d, z=1e9).count() == 0
    # and the lines only decide among extremes
    assert spam.measured(d).where(spam.extreme(0.0)).count() > 60 and spam.spam_pages(d, z=0.0).count() == 40


def test_few_pages_are_extreme(spark, data):
    d = table(spark, data.replace("sf0.001", "sf0.1"), "documents")
    m = spam.measured(d).withColumn("extreme", spam.extreme()).cache()
    plain, spammy = m.where("share <= 0.5"), m.where("share > 0.5")
    assert plain.where("extreme").count() < 0.25 * plain.count()
    assert spammy.where("extreme").count() > 0.99 * spammy.count() > 500


def test_marks():
    words, _ = spam.page("One two, three. | 12\nFour")
    got = spam.marks(words)
    assert abs(sum(got) - 1) < 1e-9 and got[0] == got[1] == got[2] == got[3] and got[-2] == got[0] and got[-1] == 4 * got[0]


def test_rank_frequency_fit(spark):
    # frequencies 1000 / r: slope -1, no residual but for rounding
    text = " ".join(f"w{chr(97 + r)}" for r in range(1, 21) for _ in range(1000 // r))
    c = spam.curves(spam.page_statistics(spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string"))).first()
    assert abs(c.slope + 1) < 0.15 and c.residual < 0.5 and abs(sum(c[f"p{j}"] for j in range(12)) - 1) < 1e-9


def test_queries(spark, data):
    assert queries.p8_found(spark, data).columns == ["doc_id"]
    m = queries.p7_mixture(spark, data)
    cap = {r.source: r.max_repeats for r in table(spark, data, "mix_targets").collect()}
    for r in m.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect():
        assert r.n <= cap[r.source]
    over = queries.p6_packs(spark, data).groupBy("pack_name", "bin_id").agg(F.sum("tokens").alias("t")).join(table(spark, data, "pack_sizes"), "pack_name").where("t > capacity_tokens")
    assert over.count() == 0
