"""Atomic facts: ranks, prompts, lenient reading of replies, spans, gates and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.config import Settings
from folio.schema import span_ok


def tier(c: Column) -> Column:
    """A rank as 1, 2 or 3: numbers 1 to 3 as they are, the names CRITICAL, IMPORTANT and NUANCE in any case, all else 3."""
    s = F.upper(c.cast("string"))
    n = F.trim(c.cast("string")).try_cast("int")
    return F.coalesce(F.when(n.isin(1, 2, 3), n).when(n.isNotNull(), 3).when(s == "CRITICAL", 1).when(s == "IMPORTANT", 2), F.lit(3))


def weight(rank: Column, how: str = "as_built") -> Column:
    """The weight of a tier in scores: its number (``as_built``), or 3, 2, 1 for 1, 2, 3 (``documented``)."""
    if how == "as_built":
        return rank
    if how == "documented":
        return F.lit(4) - rank
    raise ValueError(f"unknown weighting {how}")


def max_facts(tokens: Column) -> Column:
    """How many facts a chunk of so many tokens may give: one in 150, from 3 to 8."""
    return F.least(F.lit(8), F.greatest(F.lit(3), F.floor(tokens / 150))).cast("int")


def without_header(text: Column) -> Column:
    """Text behind its first line; a single line as it is."""
    return F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")).otherwise(text)


SYSTEM = "List the facts that the passage states. Answer with a JSON array of objects with point, reason, rank (1 critical, 2 important, 3 nuance), questions, start_char, end_char and from_overlap."
USER = "Give at most {max} facts of this passage of {tokens} tokens:\n\n{body}"


def prompts(chunks: DataFrame, tokens: Column) -> DataFrame:
    """(chunk_id, section_id, start_char, system, user): what a model is asked about each chunk of (id, section_id, start_char, text)."""
    user = F.replace(F.replace(F.replace(F.lit(USER), F.lit("{max}"), max_facts(tokens).cast("string")), F.lit("{tokens}"), tokens.cast("string")), F.lit("{body}"), without_header(F.col("text")))
    return chunks.select(F.col("id").alias("chunk_id"), "section_id", "start_char", F.lit(SYSTEM).alias("system"), user.alias("user"))


def lenient_json(replies: DataFrame, out: str, *lone: str, keys: tuple[str, ...] = ("facts", "result", "data", "items", "atomic_facts"), content: str = "content") -> DataFrame:
    """``replies`` with the column ``out``: each reply as variant array; code fences cut, a lone object with one of the keys ``lone`` wrapped, an object's first list taken.

    What can be read but holds no list gives an empty one, what can't be read null. Python's names for the constants are
    read as JSON's.
    """
    s = F.regexp_replace(F.regexp_replace(F.trim(content), r"(?is)\A\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*\z", "")
    for name, constant in (("None", "null"), ("True", "true"), ("False", "false")):
        s = F.regexp_replace(s, rf"(?<=[:\[,]\s{{0,3}}){name}(?=\s*[,\]}}])", constant)
    # a column of its own: the branches below would parse the text once each
    r = replies.withColumn("_text", s).withColumn("_json", F.try_parse_json("_text"))
    v = F.col("_json")
    x = F.when(F.schema_of_variant(v).startswith("ARRAY"), v)
    if lone:
        has = F.lit(False)
        for k in lone:
            has = has | F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
        x = x.when(has, F.try_parse_json(F.concat(F.lit("["), F.to_json(v), F.lit("]"))))
    for k in keys:
        y = F.try_variant_get(v, f"$.{k}", "variant")
        x = x.when(F.schema_of_variant(y).startswith("ARRAY"), y)
    return r.withColumn(out, x.when(v.isNotNull(), F.parse_json(F.lit("[]")))).drop("_text", "_json")


def read_facts(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, failed) of replies (chunk_id, section_id, start_char, content).

    Facts are (id, section_id, chunk_id, point, reason, rank, start_char, end_char, questions), spans moved by the
    chunk's start. Items that are no objects, come from the overlap or have an empty span are left out. ``failed`` are
    the chunks whose reply can't be read. An empty list gives no facts, and so does a reply that is JSON without a list.
    """
    r = lenient_json(replies, "v", "point", "rank")
    failed = r.where("v IS NULL").select("chunk_id", "section_id")
    items = r.where("v IS NOT NULL").select("chunk_id", "section_id", "start_char", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("nth", "x"))
    items = items.where(F.schema_of_variant("x").startswith("OBJECT"))
    get = lambda k, t: F.try_variant_get("x", f"$.{k}", t)
    # only the constant true marks a fact of the overlap, not a text or number that could be read as it
    items = items.where(~F.coalesce((F.schema_of_variant(get("from_overlap", "variant")) == "BOOLEAN") & get("from_overlap", "boolean"), F.lit(False)))
    # constants and numbers are ranks as whole numbers, names as they are
    kind = F.schema_of_variant(get("rank", "variant"))
    raw_rank = F.when(kind == "BOOLEAN", get("rank", "boolean").cast("int").cast("string")).when(kind == "STRING", get("rank", "string")).otherwise(get("rank", "double").cast("bigint").cast("string"))
    f = items.select("section_id", "chunk_id", "nth", F.coalesce(get("point", "string"), F.lit("")).alias("point"), F.coalesce(get("reason", "string"), F.lit("")).alias("reason"), tier(raw_rank).alias("rank"), (F.col("start_char") + get("start_char", "int")).alias("start_char"), (F.col("start_char") + get("end_char", "int")).alias("end_char"), F.coalesce(get("questions", "array<string>"), F.array().cast("array<string>")).alias("questions"))
    f = f.where(span_ok(F.col("start_char"), F.col("end_char")))
    return f.select(F.sha2(F.concat_ws("|", "chunk_id", F.col("nth").cast("string"), "point"), 256).alias("id"), *[c for c in f.columns if c != "nth"]), failed


def not_yet(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks (id, ...) that no fact names."""
    return chunks.join(facts.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def section_status(chunks: DataFrame, failed: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """(section_id, status): ERROR if a chunk failed, else PENDING if one has no reply yet, else DONE.

    ``answered`` has the chunks (chunk_id) that have a reply; without it all have. Sections without chunks aren't listed here.
    """
    bad = failed.select("chunk_id").distinct().withColumn("bad", F.lit(1))
    c = chunks.select("section_id", F.col("id").alias("chunk_id")).join(bad, "chunk_id", "left")
    if answered is not None:
        c = c.join(answered.select("chunk_id").distinct().withColumn("has", F.lit(1)), "chunk_id", "left")
    else:
        c = c.withColumn("has", F.lit(1))
    return c.groupBy("section_id").agg(F.when(F.max("bad") == 1, "ERROR").when(F.count("has") < F.count(F.lit(1)), "PENDING").otherwise("DONE").alias("status"))


def of_section(facts: DataFrame, section_id: str) -> DataFrame:
    """Facts of one section."""
    return facts.where(F.col("section_id") == section_id)


def of_chunk(facts: DataFrame, chunk_id: str) -> DataFrame:
    """Facts of one chunk."""
    return facts.where(F.col("chunk_id") == chunk_id)


def without_chunk(facts: DataFrame, chunk_id: str) -> DataFrame:
    """Facts but those of one chunk; facts without a chunk stay."""
    return facts.where(~F.col("chunk_id").eqNullSafe(chunk_id))


def released(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """Facts of the sections that are DONE at their latest delivery."""
    done = sections.where("id IS NOT NULL").groupBy("id").agg(F.max_by("extraction_status", "created_at").alias("status")).where("status = 'DONE'")
    return facts.join(done.select(F.col("id").alias("section_id")), "section_id", "left_semi")


def grounding(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, rank, weight, span_length, grounding): the piece of the section's text a fact's span covers; null without a span."""
    t = sections.where("id IS NOT NULL").groupBy("id").agg(F.first("raw_text", ignorenulls=True).alias("t")).withColumnRenamed("id", "section_id")
    known = F.col("start_char").isNotNull() & F.col("end_char").isNotNull()
    r = tier(F.col("rank"))
    return facts.join(t, "section_id", "left").select("id", r.alias("rank"), weight(r, "documented").alias("weight"), F.when(known, F.col("end_char") - F.col("start_char")).alias("span_length"), F.when(known & (F.col("end_char") > F.col("start_char")), F.substring(F.col("t"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).alias("grounding"))


HINT_SYSTEM = "You help a reader to recall a passage by open questions that neither answer nor quote it. Answer with a JSON array of strings."
HINT_USER = "Ask {count} questions, from the most basic fact to the finest, that can each be understood alone.\n\nFacts, which the reader must not see:\n{facts}"
MAP_SYSTEM = "You outline a long passage so that a reader knows what to expect. Be exact and leave out opinions."
MAP_USER = "First give one line for each topic of the passage, then the three to seven facts a reader must keep, all in under 300 words.\n\n{text}"


def filled(template: str, **values: Column) -> Column:
    """A text with values at its places in braces; braces inside values that were put in earlier aren't told apart, so texts come last."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def hint_prompts(facts: DataFrame, count: int = Settings.max_hints) -> DataFrame:
    """(section_id, system, user): what a model is asked for ``count`` questions on the facts of each section, critical ones first.

    Facts of one rank follow their time of creation and id; null points are left out, and sections without a point have no row.
    """
    f = facts.where("section_id IS NOT NULL AND point IS NOT NULL").select("section_id", tier(F.col("rank")).alias("r"), "created_at", "id", "point")
    one = F.sort_array(F.collect_list(F.struct("r", F.col("created_at").isNull().alias("late"), "created_at", "id", "point")))
    lines = F.array_join(F.transform(one, lambda x: F.concat(F.lit("  [Rank "), x.r.cast("string"), F.lit("] "), x.point)), "\n")
    return f.groupBy("section_id").agg(lines.alias("facts")).select("section_id", F.lit(HINT_SYSTEM).alias("system"), filled(HINT_USER, count=F.lit(str(count)), facts=F.col("facts")).alias("user"))


def read_hints(replies: DataFrame, most: int = Settings.max_hints) -> DataFrame:
    """(section_id, hint_no, hint) of replies (section_id, content) that are lists of texts; other items are left out, and at most ``most`` kept."""
    r = lenient_json(replies, "v", keys=("questions", "hints", "result", "data", "items"))
    r = r.select("section_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("nth", "x"))
    r = r.where(F.schema_of_variant("x") == "STRING").select("section_id", "nth", F.trim(F.try_variant_get("x", "$", "string")).alias("hint")).where("hint <> ''")
    w = Window.partitionBy("section_id").orderBy("nth")
    return r.withColumn("hint_no", F.row_number().over(w)).where(F.col("hint_no") <= most).select("section_id", "hint_no", "hint")


def map_prompts(sections: DataFrame, tokens: Column, more_than: int = Settings.large_section_tokens) -> DataFrame:
    """(section_id, system, user): what a model is asked for the outline of each section (id, raw_text) of more than so many tokens; null texts have none."""
    s = sections.where(F.col("id").isNotNull() & F.col("raw_text").isNotNull()).dropDuplicates(["id"]).where(tokens > more_than)
    return s.select(F.col("id").alias("section_id"), F.lit(MAP_SYSTEM).alias("system"), filled(MAP_USER, text=F.col("raw_text")).alias("user"))


def hints(facts: DataFrame, most: int = Settings.max_hints) -> DataFrame:
    """(section_id, hint_no, hint): the first question of each fact that has one, critical facts first, at most ``most`` a section.

    Facts of one rank follow their time of creation and id. As in a service that checks its limit after adding, the first
    hint is given even if ``most`` is 0 and it is the first fact's; ranks that are null count as 3.
    """
    w = Window.partitionBy("section_id").orderBy(tier(F.col("rank")), F.col("created_at").asc_nulls_last(), "id")
    f = facts.where(F.col("section_id").isNotNull()).withColumn("nth", F.row_number().over(w)).where(F.size("questions") > 0)
    own = Window.partitionBy("section_id").orderBy("nth")
    f = f.withColumn("hint_no", F.row_number().over(own))
    limit = F.col("hint_no") <= most if most > 0 else (F.col("hint_no") == 1) & (F.col("nth") == 1)
    return f.where(limit).select("section_id", "hint_no", F.col("questions")[0].alias("hint"))
