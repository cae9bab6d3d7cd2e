"""Chunks of sections at natural boundaries, with overlap, context and offsets.

The order-dependent accumulation is a fold over an array of sentences that keeps the tokens of the chunk at work and the
places where chunks begin; everything else is array expressions that take slices. The work grows with a section's length,
and only its number of chunks is ever squared. With the default counter nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.config import Settings
from folio.functions.text import strip, word_count, words
from folio.operators.text import ArrayCounter, Counter, clean, each, paragraphs, sentences, words13


def _starts(pieces: Column, size: int) -> Column:
    """The places, from 1, at which chunks begin among (text, tok, alone, first, para), and one behind the last piece."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("cur"), F.lit(True).alias("fresh"), none.alias("at"))

    def step(a: Column, x: Column) -> Column:
        # a piece that begins a paragraph, or stands alone, or is too much, closes the chunk at work
        close = (a.cur > 0) & ((x.first & (a.cur + x.para > size)) | x.alone | (a.cur + x.tok > size))
        cur = F.when(close, F.lit(0)).otherwise(a.cur)
        return F.struct((a.i + 1).alias("i"), F.when(x.alone, F.lit(0)).otherwise(cur + x.tok).alias("cur"), x.alone.alias("fresh"), F.when(close | a.fresh, F.array_append(a.at, a.i)).otherwise(a.at).alias("at"))

    return F.aggregate(pieces, start, step, lambda a: F.array_append(a.at, a.i))


def _tail(pieces: Column, budget: int) -> Column:
    """The longest run of last pieces whose tokens fit the budget, as text."""
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        stop = a.done | (x.tok > a.left)
        return F.struct(F.when(stop, a.left).otherwise(a.left - x.tok).alias("left"), stop.alias("done"), F.when(stop, a.out).otherwise(F.array_append(a.out, x.text)).alias("out"))

    return F.aggregate(F.reverse(pieces), start, step, lambda a: F.array_join(F.reverse(a.out), " "))


def _context(texts: Column, toks: Column, i: Column, budget: int) -> Column:
    """Text ``i`` with neighbours, taken in turn from left and right as long as their tokens fit what is left of the budget."""
    n = F.size(texts)
    first = F.struct((F.lit(budget) - F.element_at(toks, i + 1)).cast("int").alias("left"), F.lit(True).alias("more"), i.alias("lo"), i.alias("hi"))

    def step(a: Column, _: Column) -> Column:
        on = a.more & (a.left > 0)
        take_l = on & (a.lo > 0) & (F.coalesce(F.get(toks, a.lo - 1), F.lit(1 << 30)) <= a.left)
        left = F.when(take_l, a.left - F.get(toks, a.lo - 1)).otherwise(a.left)
        take_r = on & (a.hi < n - 1) & (F.coalesce(F.get(toks, a.hi + 1), F.lit(1 << 30)) <= left)
        return F.struct(
            F.when(take_r, left - F.get(toks, a.hi + 1)).otherwise(left).cast("int").alias("left"), (take_l | take_r).alias("more"),
            F.when(take_l, a.lo - 1).otherwise(a.lo).cast("int").alias("lo"), F.when(take_r, a.hi + 1).otherwise(a.hi).cast("int").alias("hi"),
        )

    # a step takes one text at least, so there are no more of them than smallest texts fit into the budget
    steps = F.least(n, F.floor(F.lit(budget) / F.greatest(F.array_min(toks), F.lit(1))).cast("int") + 1)
    end = F.aggregate(F.sequence(F.lit(1), steps), first, step)
    return F.array_join(F.slice(texts, end.lo + 1, end.hi - end.lo + 1), " ")


def _pieces(sections: DataFrame, size: int, counts: ArrayCounter) -> DataFrame:
    """``sections`` with ``_s``: the array of (text, tok, alone, first, para) of each text, sentences, or word windows of those beyond the size.

    ``alone`` marks windows, ``first`` the first piece of a paragraph and ``para`` the tokens of its paragraph. ``_s`` is
    null where the counter failed.
    """
    s = sections.withColumn("_t", F.transform(paragraphs(clean(F.col("raw_text"))), lambda p: F.transform(sentences(p), strip)))
    s = s.withColumn("_n", counts(F.col("_t")))
    total = lambda n: F.aggregate(n, F.lit(0), lambda a, x: a + x)
    s = s.withColumn("_y", F.zip_with("_t", "_n", lambda t, n: F.struct(t.alias("t"), n.alias("n"), total(n).alias("p"))))
    s = s.withColumn("_q", F.flatten(F.transform("_y", lambda y: F.transform(y.t, lambda t, i: F.struct(t.alias("t"), F.get(y.n, i).alias("n"), y.p.alias("p"), (i == 0).alias("first"))))))

    def windows(t: Column) -> Column:
        w = words(t)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda k: F.array_join(F.slice(w, k * size + 1, F.lit(size)), " "))

    s = s.withColumn("_w", F.transform("_q", lambda x: F.when(x.n > size, windows(x.t)).otherwise(F.array().cast("array<string>"))))
    s = s.withColumn("_wn", counts(F.col("_w")))

    def of_sentence(x: Column) -> Column:
        one = F.struct(x.q.t.alias("text"), x.q.n.alias("tok"), F.lit(False).alias("alone"), x.q.first.alias("first"), x.q.p.alias("para"))
        many = F.transform(x.w, lambda t, j: F.struct(t.alias("text"), F.get(x.n, j).alias("tok"), F.lit(True).alias("alone"), (x.q.first & (j == 0)).alias("first"), x.q.p.alias("para")))
        return F.when(x.q.n > size, many).otherwise(F.array(one))

    return s.withColumn("_s", F.flatten(F.transform(F.arrays_zip(F.col("_q").alias("q"), F.col("_w").alias("w"), F.col("_wn").alias("n")), of_sentence)))


def chunks(sections: DataFrame, settings: Settings = Settings(), count: Counter = words13, counts: ArrayCounter | None = None) -> DataFrame:
    """(id, section_id, chunk_index, text, body, chunk_level, word_count, start_char, end_char, context_text) of (section_id, raw_text[, book_title, chapter_title, section_title]).

    Null and blank texts give no chunks. Offsets count the characters of the bodies, joined by one space. With titles the
    text begins with a line of breadcrumbs. The id is a hash of section, index and text. ``chunk_level`` is
    ``word_window`` for a text without an end mark before white space. Sections are independent, so any partitioning does.

    Sizes are those of ``count``, a JVM expression, or of ``counts``, which may be a tokenizer
    (:func:`folio.operators.text.arrays_counted_by`). Sections on which a tokenizer fails give no chunks; :func:`failed` lists them.
    """
    size, over, around = settings.chunk_size, settings.chunk_overlap, settings.chunk_context
    counts = counts or each(count)
    # no filter on what is computed here: it would be moved down and the work done twice; empty arrays end as no rows
    s = _pieces(sections.where("section_id IS NOT NULL AND raw_text IS NOT NULL"), size, counts)
    s = s.withColumn("_at", _starts(F.col("_s"), size))
    s = s.withColumn("_c", F.when(F.size("_at") > 1, F.transform(F.sequence(F.lit(0), F.size("_at") - 2), lambda k: F.slice("_s", F.get("_at", k), F.get("_at", k + 1) - F.get("_at", k)))))
    s = s.withColumn("_body", F.transform("_c", lambda c: F.array_join(F.transform(c, lambda x: x.text), " ")))
    tails = F.transform("_c", lambda c, i: F.when((i > 0) & F.lit(over > 0), _tail(F.get(F.col("_c"), i - 1), over)).otherwise(F.lit("")))
    s = s.withColumn("_tail", tails)
    s = s.withColumn("_text", F.zip_with("_tail", "_body", lambda t, b: F.when(t != "", F.concat_ws(" ", t, b)).otherwise(b)))
    s = s.withColumn("_tok", counts(F.array("_text"))[0])
    s = s.withColumn("_ctx", F.transform(F.sequence(F.lit(0), F.size("_text") - 1), lambda i: _context(F.col("_text"), F.col("_tok"), i, around)))
    s = s.withColumn("_off", F.aggregate("_body", F.array(F.lit(0)), lambda a, b: F.array_append(a, F.element_at(a, -1) + F.length(b) + 1)))
    titled = "book_title" in sections.columns
    head = F.lit("")
    if titled:
        head = F.concat(F.lit("["), F.concat_ws(" > ", F.coalesce("book_title", F.lit("Unknown Book")), F.when(F.coalesce("chapter_title", F.lit("")) != "", F.col("chapter_title")), F.coalesce("section_title", F.lit("Unknown Section"))), F.lit("]\n"))
    out = s.select("section_id", head.alias("_head"), F.posexplode(F.arrays_zip(F.col("_body").alias("body"), F.col("_text").alias("text"), F.col("_ctx").alias("ctx"), F.col("_off").alias("off"))).alias("chunk_index", "x"))
    out = out.where("x.body IS NOT NULL")
    level = F.when(F.col("x.text").contains("\n\n"), "paragraph").when(F.col("x.text").rlike(r"(?U)[.!?][\s\x1c-\x1f]"), "sentence").otherwise("word_window")
    out = out.select("section_id", "chunk_index", F.concat("_head", "x.text").alias("text"), F.col("x.body").alias("body"), level.alias("chunk_level"), word_count(F.col("x.body")).alias("word_count"), F.col("x.off").alias("start_char"), (F.col("x.off") + F.length("x.body")).alias("end_char"), F.col("x.ctx").alias("context_text"))
    return out.select(F.sha2(F.concat_ws("|", "section_id", F.col("chunk_index").cast("string"), "text"), 256).alias("id"), *out.columns)


def failed(sections: DataFrame, counts: ArrayCounter) -> DataFrame:
    """(section_id): sections with a text on whose sentences the counter fails; their texts are in no chunk."""
    s = sections.where("section_id IS NOT NULL AND raw_text IS NOT NULL").select("section_id", F.transform(paragraphs(clean(F.col("raw_text"))), sentences).alias("_t"))
    return s.withColumn("_n", counts(F.col("_t"))).where("_n IS NULL").select("section_id").distinct()
