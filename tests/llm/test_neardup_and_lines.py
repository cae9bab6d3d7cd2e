import random
from collections import defaultdict

import regex
from oracle import same

from folio.llm import boilerplate, neardup, queries
from folio.session import table


def _brute(rows, k, threshold, least):
    sets = []
    for i, x in rows:
        if i is not None and x is not None:
            x = regex.sub(r"[^\p{L}\p{N}]+", "", x.lower())
            if len(x) >= least:
                sets.append((i, {x[j : j + k] for j in range(len(x) - k + 1)}))
    out = set()
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i != j and len(a & b) >= threshold * len(a | b) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def _found(df, col, cfg):
    return {tuple(r) for r in neardup.expand(*neardup.similar(df, "id", col, **cfg)).collect()}


def test_tables_against_brute_force(spark, data):
    for name, col, cfg in (("sections", "raw_text", neardup.TEXT), ("toc_entries", "title", neardup.TITLE)):
        df = table(spark, data, name).select("id", col).distinct()
        h = cfg["how"]
        assert _found(df, col, cfg) == _brute(df.collect(), h["k"], h["threshold"], cfg["least"])


def _edited(rng, text, n):
    x = list(text)
    for _ in range(n):
        k = rng.randrange(len(x))
        how = rng.randrange(3)
        if how == 0:
            x[k] = rng.choice("abcdefgh")
        elif how == 1:
            x.insert(k, rng.choice("abcdefgh"))
        else:
            del x[k]
    return "".join(x)


def test_titles_with_edits_near_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for g in range(150):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(20, 60)))
        rows += [(f"{g:03d}-{j}", _edited(rng, base, rng.randint(0, 4))) for j in range(3)]
    df = spark.createDataFrame(rows, "id string, title string")
    assert _found(df, "title", neardup.TITLE) == _brute(rows, 3, 0.7, 20)


def test_popular_titles_and_their_edited_copies(spark):
    # the title's tokens stand in many rows, the tokens around an edit in few
    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(24, 60)))
        rows += [(f"{g:02d}-{j:02d}", base) for j in range(20)] + [(f"{g:02d}-e{j}", _edited(rng, base, 1 + j % 2)) for j in range(3)]
    parts = ["abcdefghi", "jklmnopqr", "stuvwxyzq"]
    rows += [("r0", "".join(parts)), ("r1", "".join(parts[::-1]))]  # 21 of 29 runs in both, none of 10 characters
    df = spark.createDataFrame(rows, "id string, title string")
    want = _brute(rows, 3, 0.7, 20)
    assert ("r0", "r1") in want and _found(df, "title", neardup.TITLE) == want


def test_large_group_of_near_copies(spark):
    # more near copies than a token may have: they go the second route
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    rows = [(f"{k:03d}", _edited(rng, base, 3)) for k in range(60)] + [(f"x{k}", base) for k in range(30)] + [("n", None), (None, base), ("e", "")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id string, raw_text string, h string")
    got = _found(df, "raw_text", neardup.TEXT)
    assert got == _brute(rows, 12, 0.6, 200) and len(got) > 3000
    g = neardup.groups(*neardup.similar(df, "id", "raw_text", **neardup.TEXT)).collect()
    assert len(g) == 90 and {r.group_id for r in g} == {"000"}


def test_titles_of_one_series(spark):
    # a prefix of 24 letters in all of them; each pair just above the threshold
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    series = "".join(rng.choice(letters) for _ in range(24))
    rows = []
    for g in range(200):
        a = series + "".join(rng.choice(letters) for _ in range(18))
        k = 24 + rng.randrange(4, 14)
        rows += [(f"{g:03d}a", a), (f"{g:03d}b", a[:k] + rng.choice(letters.replace(a[k], "")) + a[k + 1 :])]
    df = spark.createDataFrame(rows, "id string, title string")
    want = _brute(rows, 3, 0.7, 20)
    assert len(want) >= 200 and _found(df, "title", neardup.TITLE) == want


def test_common_notice_and_spread_edits(spark):
    # a quarter of each text is a notice all of them have, the rest has an edit every 37 or so letters
    letters = "abcdefghijklmnopqrstuvwxyz"
    for seed, every in ((5, 37), (6, 39), (7, 36)):
        rng = random.Random(seed)
        notice = "".join(rng.choice(letters) for _ in range(500))
        rows = []
        for g in range(200):
            a = "".join(rng.choice(letters) for _ in range(1500))
            b = list(a)
            for at in range(every // 2, 1500, every):
                b[at] = rng.choice(letters.replace(a[at], ""))
            rows += [(f"{g:03d}a", notice + a), (f"{g:03d}b", notice + "".join(b))]
        df = spark.createDataFrame(rows, "id string, raw_text string")
        # only pairs of one g can be that similar: the others have the notice in common and no more
        want = {x for g in range(200) for x in _brute(rows[2 * g : 2 * g + 2], 12, 0.6, 200)}
        assert (every == 36 or len(want) > 100) and _found(df, "raw_text", neardup.TEXT) == want


def test_hot_key_is_divided(spark):
    rows = spark.createDataFrame([("k", i, 50) for i in range(50)] + [("l", 99, 1)], "key string, id long, n long")
    got = neardup.meet(rows, "key", "id", most=7)
    assert got.count() == got.distinct().count() == 50 * 49 // 2 and got.select("part").distinct().count() == 8
    assert neardup.agreement(0.6, 384) == 264


def test_first_tokens_agree_as_often_as_the_sets(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij") for _ in range(900))
    for k, orders, parts, n in ((12, 384, 64, 900), (3, 192, 1, 45)):
        off = 0.0
        for _ in range(60):
            t = base[: n // 2] + "".join(rng.choice("abcdefghij") for _ in range(n // 2))
            a, b = neardup.runs(t, k), neardup.runs(_edited(rng, t, n // 50 + 1), k)
            off += (neardup.firsts(a, orders, parts) == neardup.firsts(b, orders, parts)).mean() - neardup.similarity(a, b)
        assert abs(off / 60) < 0.015


def test_chain_is_one_group(spark):
    # each text overlaps only with its neighbours
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    df = spark.createDataFrame([(f"{k:02d}", long[k * 60 : k * 60 + 400]) for k in range(40)], "id string, raw_text string")
    g = neardup.groups(*neardup.similar(df, "id", "raw_text", **neardup.TEXT)).collect()
    assert {r.group_id for r in g} == {"00"} and {r.links for r in g} >= {1, 2}


def test_groups_of_both_fields(spark, data):
    got = {(r.field, r.id): r.group_id for r in queries.p4_groups(spark, data).collect()}
    assert {f for f, _ in got} == {"text", "title"}
    for field, name, col, cfg in (("text", "sections", "raw_text", neardup.TEXT), ("title", "toc_entries", "title", neardup.TITLE)):
        rows = table(spark, data, name).select("id", col).distinct().collect()
        near = defaultdict(set)
        for a, b in _brute(rows, cfg["how"]["k"], cfg["how"]["threshold"], cfg["least"]):
            near[a].add(b)
            near[b].add(a)
        mine = [i for f, i in got if f == field]
        assert near and near.keys() <= set(mine)
        for i in mine:
            group, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            assert got[field, i] == min(group)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, raw_text string")
    member, pairs = neardup.similar(df, "id", "raw_text", **neardup.TEXT)
    assert pairs.count() == 0 and neardup.groups(member, pairs).count() == 0 and neardup.expand(member, pairs).count() == 0


def test_lines_equal_sql(spark, data):
    for q in ("p5_found", "p5_cleaned"):
        same(spark, data, queries.QUERIES[q], queries.SQL[q])


def test_blocks(spark):
    rows, toc = [], []
    for k in range(10):
        rows.append((f"s{k}", f"Own line {chr(97 + k)}.\nShare this\n\nRead more 12  times\n{'Other footer' if k < 5 else 'x'}\n***"))
        toc += [("b", f"s{k}"), ("b", f"s{k}")]
    rows += [("s0", rows[0][1]), ("z", None), ("y", " \n")]
    toc += [("b", "z"), ("b", "y"), ("b", "gone"), (None, "s1"), ("b", None), ("c", "s1")]
    s, t = spark.createDataFrame(rows, "id string, raw_text string"), spark.createDataFrame(toc, "book_id string, section_id string")
    got = boilerplate.repeated_lines(s, t).collect()
    lines = defaultdict(set)
    for r in got:
        lines[r.line_no].add(r.section_id)
    assert len(lines[2]) == len(lines[4]) == 10 and len(lines[5]) == 10 and 1 not in lines and 6 not in lines
    # a third of the lines' sections, and more, in one book: each line counts by itself, each block once
    b = {(r.book_id, r.block): r for r in boilerplate.blocks(boilerplate.repeated_lines(s, t)).collect()}
    assert sum(r.lines for r in b.values()) == len({(r.book_id, r.line) for r in got}) and all(r.sections <= r.occurrences and r.support <= 10 for r in b.values())
    # neighbouring lines are one block
    assert len({r.block for r in got if r.line_no in (2, 4)}) == 1
    text = {r.section_id: r.text for r in boilerplate.without_repeated_lines(s, t).collect()}
    assert text["s0"] == "Own line a.\n\n***" and text["z"] is None and text["y"] == " \n"
    assert boilerplate.repeated_lines(s.limit(0), t).count() == 0 and boilerplate.repeated_lines(s, t.limit(0)).count() == 0
