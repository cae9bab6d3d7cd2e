import random

from folio.operators import toc


def _toc(spark, levels, hrefs=None):
    rows = [(f"{k:04d}", "b", f"t{k}", lv, k * 3, hrefs[k] if hrefs else None, None) for k, lv in enumerate(levels)]
    return spark.createDataFrame(rows, "id string, book_id string, title string, level int, toc_order int, href string, section_id string")


def _kept(levels):
    # the builder's own words: a child is exactly one level deeper; what is deeper is dropped with all below it
    out, stack = [False] * len(levels), []
    for k, lv in enumerate(levels):
        while stack and levels[stack[-1]] >= lv:
            stack.pop()
        out[k] = (out[stack[-1]] and levels[stack[-1]] == lv - 1) if stack else lv == 1
        stack.append(k)
    return out


def test_tree_on_random_levels(spark):
    rng = random.Random(1)
    for _ in range(4):
        levels = [rng.randint(1, 5) for _ in range(60)]
        got = toc.tree(_toc(spark, levels)).orderBy("ord").collect()
        assert [r.kept for r in got] == _kept(levels)
        parents = [max((j for j in range(k) if levels[j] < levels[k]), default=None) for k in range(60)]
        assert [r.parent_ord for r in got] == [None if p is None else p + 1 for p in parents]


def test_jumps(spark):
    assert [r.kept for r in toc.tree(_toc(spark, [1, 3, 4, 2])).orderBy("ord").collect()] == [True, False, False, True]
    assert [r.kept for r in toc.tree(_toc(spark, [2, 1])).orderBy("ord").collect()] == [False, True]
    assert toc.tree(_toc(spark, [1]).limit(0)).count() == 0


def test_path_ids(spark):
    got = toc.path_ids(_toc(spark, [1, 2, 2, 1, 3, 2])).orderBy("ord").collect()
    assert [r.path_id for r in got] == ["001", "001.001", "001.002", "002", "002.000.001", "002.001"]


def test_path_ids_of_more_than_a_thousand_rows(spark):
    # level 1: 1,200 rows, then 1,100 of level 2 below the last of them
    paths = toc.path_ids(_toc(spark, [1] * 1200 + [2] * 1100))
    got = [r.path_id for r in paths.orderBy("ord").collect()]
    assert got == [f"{k:03d}" for k in range(1, 1201)] + [f"1200.{k:03d}" for k in range(1, 1101)]
    assert toc.under_path(paths, "100").count() == 1 and toc.under_path(paths, "120").count() == 1
    under = {r.path_id: r.parent_path for r in toc.under_path(paths, "1200").collect()}
    assert len(under) == 1101 and under["1200.1100"] == "1200" and under["1200"] is None


def test_large_group_is_split(spark):
    n = 9000
    levels = [1 + k % 3 for k in range(n)]
    got = toc.subtrees(_toc(spark, levels))
    assert got.where("level = 1 AND descendants <> 2").count() == 0 and got.count() == n


def test_stop_anchors(spark):
    t = _toc(spark, [1, 2, 1, 1, 1, 1], ["a#1", "a#2", "a", "a#4", "b#5", "a#6"])
    got = {r.id: r.stop_anchor for r in toc.stop_anchors(t).collect()}
    # the child is passed over, so is the row without an anchor; another file ends the scan
    assert got == {"0000": "4", "0001": "4", "0002": "4", "0003": None, "0004": None, "0005": None}


def test_nested(spark):
    top = toc.as_nested(toc.tree(_toc(spark, [1, 2, 3, 1, 3])).collect())
    assert [n["title"] for n in top] == ["t0", "t3"] and top[0]["children"][0]["children"][0]["title"] == "t2" and top[1]["children"] == []


def test_nulls_and_repeats(spark):
    t = spark.createDataFrame([("x", "b", None, 1, 1, None, None), ("x", "b", None, 1, 1, None, None), (None, "b", "t", 1, 2, None, None), ("y", None, "t", 1, 2, None, None), ("z", "b", "t", None, 3, None, None)], "id string, book_id string, title string, level int, toc_order int, href string, section_id string")
    got = toc.tree(t).collect()
    assert len(got) == 1 and got[0].breadcrumb == ""


def test_page_ranges_across_ranges_of_pages(spark):
    pages = [1, 2, 4095, 4096, 4097, 9000, 20_000, 20_001]
    t = spark.createDataFrame([("b", f"{p}-{k}", str(p)) for p in pages for k in range(2)] + [("b", "x", "a.xhtml"), (None, "y", "3"), ("c", "z", "7")], "book_id string, id string, href string")
    n = spark.createDataFrame([("b", 20_500), ("c", 9)], "book_id string, n_pages int")
    got = {(r.book_id, r.start_page): r.end_page for r in toc.page_ranges(t, n).collect()}
    assert got == {**{("b", p): q for p, q in zip(pages, pages[1:] + [20_501])}, ("c", 7): 10}
