import json

from pyspark.sql import functions as F

from folio import providers
from folio.operators import audit, facts
from folio.schema import checked, span_ok


def test_tiers(spark):
    cases = {"1": 1, "2": 2, "3": 3, "0": 3, "99": 3, "NUANCE": 3, "nuance": 3, "IMPORTANT": 2, "important": 2, "CRITICAL": 1, "critical": 1, "INVALID": 3, None: 3, " 2 ": 2}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "r string, x int")
    assert df.where(facts.tier(F.col("r")) != F.col("x")).count() == 0


def test_lenient_replies(spark):
    one = {"point": "p", "rank": 1, "questions": ["q"]}
    texts = [json.dumps([one]), "```json\n" + json.dumps([one]) + "\n```", json.dumps({"facts": [one]}), json.dumps({"data": [one]}), json.dumps(one), json.dumps([one, 7, {"point": "o", "from_overlap": True}]), "no json", json.dumps({"x": 1}), "[]", json.dumps([{"point": "p", "rank": None, "start_char": 5, "end_char": 5}]), None]
    df = spark.createDataFrame([(str(k), "s", 10, t) for k, t in enumerate(texts)], "chunk_id string, section_id string, start_char int, content string")
    good, bad = facts.read_facts(df)
    assert sorted((r.chunk_id, r.point, r["rank"]) for r in good.collect()) == [(str(k), "p", 1) for k in range(6)]
    # JSON without a list holds no facts, but can be read
    assert {r.chunk_id for r in bad.collect()} == {"6", "10"}


def test_overlap_and_ranks_as_constants(spark):
    items = [{"point": f"p{k}", "from_overlap": x, "rank": r} for k, (x, r) in enumerate([(True, 1), ("true", 2.7), (1, True), (False, False), (None, "critical"), ("x", "2"), (False, None), (False, [1])])]
    df = spark.createDataFrame([("c", "s", 0, json.dumps(items))], "chunk_id string, section_id string, start_char int, content string")
    assert {r.point: r["rank"] for r in facts.read_facts(df)[0].collect()} == {"p1": 2, "p2": 1, "p3": 3, "p4": 1, "p5": 2, "p6": 3, "p7": 3}
    df = spark.createDataFrame([(str(k), "s", 0, t) for k, t in enumerate(['{"a": 1}', "7", '"text"', "null", "{broken"])], "chunk_id string, section_id string, start_char int, content string")
    good, bad = facts.read_facts(df)
    assert good.count() == 0 and [r.chunk_id for r in bad.collect()] == ["4"]


def test_status_of_sections_without_replies(spark):
    c = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("c", "5")], "section_id string, id string")
    failed = spark.createDataFrame([("4",)], "chunk_id string")
    answered = spark.createDataFrame([("1",), ("3",), ("4",)], "chunk_id string")
    assert dict(map(tuple, facts.section_status(c, failed, answered).collect())) == {"a": "PENDING", "b": "DONE", "c": "ERROR"}
    assert dict(map(tuple, facts.section_status(c, failed).collect())) == {"a": "DONE", "b": "DONE", "c": "ERROR"}


def test_generated_hints_and_maps(spark):
    f = spark.createDataFrame([("2", None, "s", "late", 2), ("1", None, "s", "first", 1), ("3", None, "s", None, 1), ("4", None, None, "x", 1)], "id string, created_at timestamp, section_id string, point string, rank int")
    (p,) = facts.hint_prompts(f, 3).collect()
    assert p.section_id == "s" and "Ask 3 questions" in p.user and p.user.index("[Rank 1] first") < p.user.index("[Rank 2] late") and "None" not in p.user
    r = spark.createDataFrame([("s", '```json\n["Why?", 7, " ", "How?", "Who?"]\n```'), ("t", "no"), ("u", '{"questions": ["One?"]}')], "section_id string, content string")
    assert sorted(map(tuple, facts.read_hints(r, 2).collect())) == [("s", 1, "Why?"), ("s", 2, "How?"), ("u", 1, "One?")]
    s = spark.createDataFrame([("a", "w " * 50), ("a", "w " * 50), ("b", "short"), ("c", None)], "id string, raw_text string")
    (m,) = facts.map_prompts(s, F.size(F.split("raw_text", " ")), 20).collect()
    assert m.section_id == "a" and m.user.endswith("w " * 50)


def test_prompts_and_reads_by_key(spark):
    c = spark.createDataFrame([("k", "s", 0, "[head]\nBody text.")], "id string, section_id string, start_char int, text string")
    p = facts.prompts(c, F.lit(600)).first()
    assert "at most 4 facts" in p.user and p.user.endswith("Body text.") and "[head]" not in p.user
    f = spark.createDataFrame([("1", "s", "k"), ("2", "s", None), ("3", "t", "l")], "id string, section_id string, chunk_id string")
    assert [r.id for r in facts.of_section(f, "s").orderBy("id").collect()] == ["1", "2"] and [r.id for r in facts.of_chunk(f, "k").collect()] == ["1"]
    assert [r.id for r in facts.without_chunk(f, "k").orderBy("id").collect()] == ["2", "3"]


def test_spans_are_moved(spark):
    df = spark.createDataFrame([("c", "s", 100, '[{"point": "p", "rank": "critical", "start_char": 1, "end_char": 4}, {"point": "q", "start_char": 2}]')], "chunk_id string, section_id string, start_char int, content string")
    got = facts.read_facts(df)[0].orderBy("point").collect()
    assert [(r.start_char, r.end_char, r["rank"]) for r in got] == [(101, 104, 1), (102, None, 3)]


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1), (3, 3)], "a int, b int")
    ok, bad = checked(df, span=span_ok(F.col("a"), F.col("b")))
    assert ok.count() == 2 and [r.broken for r in bad.collect()] == [["span"]] * 2


def test_hints(spark):
    rows = [("1", "s", 3, ["a", "b"]), ("2", "s", 1, []), ("3", "s", 1, ["c"]), ("4", "s", None, ["d"]), ("5", None, 1, ["e"]), ("6", "s", 2, None)]
    f = spark.createDataFrame([(i, None, s, r, q) for i, s, r, q in rows], "id string, created_at timestamp, section_id string, rank int, questions array<string>")
    assert [r.hint for r in facts.hints(f, 2).orderBy("hint_no").collect()] == ["c", "a"]
    assert facts.hints(f, 0).count() == 0
    assert [r.hint for r in facts.hints(f.where("id <> '2'"), 0).collect()] == ["c"]


def _audit(spark):
    f = spark.createDataFrame([("f1", 1, "p1"), ("f2", 3, None)], "id string, rank int, point string")
    v = spark.createDataFrame([("r", "f1", "found", None, 0.5), ("r", "f2", "partial", "e", 1.0), ("r", "zz", "found", None, 1.0), ("r", "f1", "missing", None, 1.0)], "report_id string, atomic_fact_id string, status string, evidence string, confidence double")
    r = spark.createDataFrame([("s", 1, "r"), ("s", 2, "empty")], "section_id string, attempt int, report_id string")
    return r, v, f


def test_scores(spark):
    r, v, f = _audit(spark)
    as_built = {x.report_id: x.score for x in audit.scores(r, v, f).collect()}
    assert abs(as_built["r"] - (1 * 0.5 + 3 * 0.5) / 5 * 100) < 1e-9 and as_built["empty"] == 0.0
    documented = {x.report_id: x.score for x in audit.scores(r, v, f, "documented", False).collect()}
    assert abs(documented["r"] - (3 * 1 + 1 * 0.5) / 7 * 100) < 1e-9
    h = audit.history(r.join(audit.scores(r, v, f), "report_id"), v, f).orderBy("attempt").collect()
    assert h[0].score_delta is None and abs(h[1].score_delta + as_built["r"]) < 1e-9 and (h[0].n_facts, h[1].n_facts) == (4, 0)


def test_feedback_and_digest(spark):
    _, v, f = _audit(spark)
    got = {(x.atomic_fact_id, x.status): x for x in audit.feedback(v, f).collect()}
    assert got["zz", "found"].point == "" and got["zz", "found"]["rank"] == 3 and got["f1", "missing"].message == "You left out a key point."
    assert audit.digest(v).first().digest == "  Found         f1, zz\n  Partial       f2\n  Missing       f1\n  Contradicted  none"


def test_validations_are_read(spark):
    a = '{"results": [{"fact_id": "f", "status": "FOUND", "confidence": 0.9, "improved": True}, {"fact_id": "g", "status": "odd"}, {"status": "found"}, {"fact_id": "h", "status": "missing", "evidence": None}]}'
    df = spark.createDataFrame([("r", a), ("q", "[]"), ("p", "broken")], "report_id string, content string")
    got = audit.read_validations(df).orderBy("atomic_fact_id").collect()
    assert [(x.atomic_fact_id, x.status, x.confidence, x.improved, x.evidence) for x in got] == [("f", "found", 0.9, True, ""), ("h", "missing", 0.0, None, "")]


def test_gates(spark):
    s = spark.createDataFrame([("a", "DONE", 1), ("b", "PENDING", 2), ("b", "DONE", 1), ("c", "DONE", 1)], "id string, extraction_status string, created_at int")
    f = spark.createDataFrame([("a",)], "section_id string")
    m = spark.createDataFrame([("1", "a", "w " * 60), ("2", "a", "short"), ("3", "b", "w " * 60), ("4", "z", None), ("5", "c", "w " * 60)], "id string, section_id string, text string")
    assert {r.id: r.reason for r in audit.gated(m, s, f).collect()} == {"1": None, "2": "too short", "3": "section not done", "4": "no such section", "5": "no facts"}


def test_providers(spark):
    p = spark.createDataFrame([("1", "s", "u"), ("2", "s", "bad")], "id string, system string, user string")

    def call(system, user):
        if user == "bad":
            raise ValueError("no")
        return user.upper()

    got = {r.id: (r.content, r.error) for r in providers.complete(p, call).collect()}
    assert got == {"1": ("U", None), "2": (None, "no")}
    stored = spark.createDataFrame([("1", "x")], "id string, content string")
    assert {r.id: r.error for r in providers.replay(p, stored, "id").collect()} == {"1": None, "2": "no reply"}
    tries = []

    def flaky(s, u):
        tries.append(u)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert providers.with_retries(flaky, 3, 0)("s", "u") == "ok"


def _attempts(spark):
    s = spark.createDataFrame([("m1", "s", "first try", 1), ("m2", "s", "second try", 2), ("m3", "s", None, 3), ("m1", "s", "first try", 1), ("n1", "t", "alone", 1), (None, "t", "x", 2)], "id string, section_id string, text string, submitted_at int")
    r = spark.createDataFrame([("r1", "m1", 66.665), ("r0", "m1", 1.0), ("r2", "m2", 70.0)], "report_id string, summary_id string, score double")
    v = spark.createDataFrame([("r1", "f1", "found"), ("r1", "f2", "missing")], "report_id string, atomic_fact_id string, status string")
    return s, r, v


def test_previous_attempts_and_prompts(spark):
    s, r, v = _attempts(spark)
    p = audit.previous(s, r, v)
    got = {x.id: x for x in p.collect()}
    assert set(got) == {"m1", "m2", "m3", "n1"} and got["m1"].previous_id is None and got["n1"].previous_report is None
    assert (got["m2"].previous_id, got["m2"].previous_report, got["m2"].previous_score, got["m2"].previous_text) == ("m1", "r1", 66.665, "first try")
    assert "Found         f1" in got["m2"].digest and got["m3"].previous_report == "r2" and got["m3"].digest is None
    f = spark.createDataFrame([("f1", "s", 1, "p1", None)], "id string, section_id string, rank int, point string, created_at timestamp")
    q = {x.id: x.user for x in audit.validation_prompts(s, f, p).collect()}
    assert set(q) == {"m1", "m2", "m3"} and "first attempt" in q["m1"] and '"point":"p1"' in q["m1"]
    assert "Attempt 1 scored 66.6" in q["m2"] and "first try" in q["m2"] and "Missing       f2" in q["m2"]
    assert "Missing       none" in q["m3"] and audit.of_section(s, "t").count() == 2


def test_audits_are_stored(spark, tmp_path):
    s, r, v = _attempts(spark)
    for _ in range(2):
        audit.store(str(tmp_path), s.withColumn("submitted_at", F.lit(None)), r.withColumnRenamed("report_id", "id"), v)
    from folio import schema

    for name, n in (("summary", 12), ("report", 6), ("validation", 4)):
        t = spark.read.parquet(f"{tmp_path}/{name}")
        assert t.count() == n and t.columns == getattr(schema, name.upper()).names
    assert audit.of_fact(v, "f1").count() == 1 and audit.of_report(v, "r1").count() == 2 and audit.of_report(v, "zz").count() == 0
