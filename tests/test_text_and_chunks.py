import random

from pyspark.sql import functions as F

from folio.config import Settings
from folio.operators import chunk, text


def _chunks(spark, raw, size, over, around):
    df = spark.createDataFrame([("s", raw)], "section_id string, raw_text string")
    return chunk.chunks(df, Settings(chunk_size=size, chunk_overlap=over, chunk_context=around)).orderBy("chunk_index").collect()


def test_accumulation(spark):
    got = _chunks(spark, "This is the first sentence. This is the second. And the third.", 12, 0, 50)
    assert [r.text for r in got] == ["This is the first sentence. This is the second.", "And the third."]
    assert [r.chunk_level for r in got] == ["sentence", "word_window"]


def test_overlap(spark):
    got = _chunks(spark, "Sentence one. Sentence two. Sentence three. Sentence four.", 4, 2, 50)
    assert [r.text for r in got] == ["Sentence one. Sentence two.", "Sentence two. Sentence three. Sentence four."]


def test_context(spark):
    got = _chunks(spark, "A. B. C. D. E.", 1, 0, 15)
    assert len(got) == 5 and got[2].text == "C." and "B. C. D." in got[2].context_text and "A. B. C." in got[0].context_text


def test_word_windows(spark):
    got = _chunks(spark, "This is a massive run on sentence that never ends and just keeps going and going.", 10, 0, 50)
    assert [r.text for r in got] == ["This is a massive run on sentence that never ends", "and just keeps going and going."]
    assert {r.chunk_level for r in got} == {"word_window"}


def test_cleaning(spark):
    got = _chunks(spark, "Here is a bro-\nken word. \f  Lots of spaces.   \n\n\n\nToo many newlines.", 50, 0, 100)
    t = " ".join(r.text for r in got)
    assert "broken word" in t and "Lots of spaces." in t and "\f" not in t and "\n\n\n" not in t


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([("a", ""), ("b", "   \n  \t  "), ("c", None), (None, "x")], "section_id string, raw_text string")
    assert chunk.chunks(df).count() == 0
    assert chunk.chunks(df.limit(0)).count() == 0


def test_paragraph_flush_and_offsets(spark):
    rng = random.Random(3)
    raw = "\n\n".join(" ".join(f"Word{rng.randint(0, 99)} " * rng.randint(1, 9) + "end." for _ in range(rng.randint(1, 5))) for _ in range(30))
    got = _chunks(spark, raw, 40, 10, 100)
    assert all(r.end_char - r.start_char == len(r.body) for r in got)
    assert all(b.start_char == a.end_char + 1 for a, b in zip(got, got[1:]))
    assert " ".join(r.body for r in got).split() == raw.split()


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1, "x")], "section_id string, raw_text string, chunk_index int, text string")
    assert [r.body for r in chunk.chunks(df).collect()] == ["One. Two."]


def test_clean_handles_unicode(spark):
    df = spark.createDataFrame([("caf-\né",), ("x \n",), (None,)], "t string")
    assert [r.x for r in df.select(text.clean(F.col("t")).alias("x")).collect()] == ["café", "x", None]


def test_exact_counter(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "t string")
    assert [r.n for r in df.select(text.counted_by(lambda x: len(x.split()))("t").alias("n")).collect()] == [3, 1]


def _words(x):
    return len(x.split())


def test_another_counter(spark):
    # sizes, context and windows all follow the counter that is given, a JVM expression or a tokenizer alike
    raw = "One two three four. Five six seven. Eight nine.\n\nTen eleven twelve thirteen fourteen fifteen sixteen seventeen. Eighteen."
    df = spark.createDataFrame([("s", raw)], "section_id string, raw_text string")
    for size, over, around in ((4, 0, 8), (7, 2, 10), (3, 1, 6)):
        by_words = text.each(lambda c: F.greatest(F.lit(1), F.size(F.split(c, r"\s+"))))
        a, b = (sorted(chunk.chunks(df, Settings(chunk_size=size, chunk_overlap=over, chunk_context=around), counts=c).drop("id").collect()) for c in (by_words, text.arrays_counted_by(lambda x: len(x.split()))))
        assert a == b and all(_words(r.body) <= size for r in a)
        assert all(_words(r.context_text) <= max(around, _words(r.text)) for r in a)
    df = spark.createDataFrame([("s", "A b c d. E f g h. I j k l. M n o p. Q r s t.")], "section_id string, raw_text string")
    got = chunk.chunks(df, Settings(chunk_size=4, chunk_overlap=0, chunk_context=12), counts=text.arrays_counted_by(lambda x: len(x.split()))).orderBy("chunk_index").collect()
    assert got[2].context_text == "E f g h. I j k l. M n o p."


def test_a_failing_counter_is_kept_to_its_section(spark):
    def encode(x):
        if "bad" in x:
            raise ValueError(x)
        return len(x)

    df = spark.createDataFrame([("a", "Good one. Two."), ("b", "A bad one."), ("c", None), (None, "bad")], "section_id string, raw_text string")
    count = text.arrays_counted_by(encode)
    assert {r.section_id for r in chunk.chunks(df, counts=count).collect()} == {"a"}
    assert [r.section_id for r in chunk.failed(df, count).collect()] == ["b"]


def test_very_long_section(spark):
    df = spark.createDataFrame([("s",)], "section_id string").select("section_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.concat(F.lit("Sentence number "), k.cast("string"), F.lit(" is here."))), " ").alias("raw_text"))
    r = chunk.chunks(df).agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("w")).first()
    assert r.w == 500_000 and r.n > 600
