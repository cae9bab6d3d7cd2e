"""Audit of summaries: gates, attempts, scores, feedback and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.config import Settings
from folio.functions.text import word_count
from folio.operators.facts import filled, lenient_json, tier, weight
from folio.schema import FACT_STATUS, REPORT, SUMMARY, VALIDATION
from folio.sources.books import append


def long_enough(summaries: DataFrame, least: int = Settings.min_summary_words) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): summaries with at least ``least`` words, and the others; null texts have none."""
    n = word_count(F.col("text"))
    return summaries.where(n >= least), summaries.where(n < least)


def gated(summaries: DataFrame, sections: DataFrame, facts: DataFrame, least: int = Settings.min_summary_words) -> DataFrame:
    """(id, section_id, reason) of each summary: why it can't be audited, null if it can.

    The reasons are, in this order, ``no such section``, ``section not done``, ``too short`` and ``no facts``.
    """
    s = sections.where("id IS NOT NULL").groupBy("id").agg(F.max_by("extraction_status", "created_at").alias("status")).withColumnRenamed("id", "section_id")
    f = facts.where("section_id IS NOT NULL").select("section_id").distinct().withColumn("has", F.lit(True))
    j = summaries.join(s.withColumn("known", F.lit(True)), "section_id", "left").join(f, "section_id", "left")
    why = F.when(F.col("known").isNull(), "no such section").when(F.coalesce("status", F.lit("")) != "DONE", "section not done").when(word_count(F.col("text")) < least, "too short").when(F.col("has").isNull(), "no facts")
    return j.select("id", "section_id", why.alias("reason"))


def attempts(summaries: DataFrame) -> DataFrame:
    """``summaries`` with ``attempt``, counted from 1 within a section by time of submission and id; null times come last."""
    w = Window.partitionBy("section_id").orderBy(F.col("submitted_at").asc_nulls_last(), "id")
    return summaries.where("section_id IS NOT NULL").withColumn("attempt", F.row_number().over(w))


def latest_attempt(summaries: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, latest): the greatest attempt number of each section, 0 where there is none."""
    m = summaries.groupBy("section_id").agg(F.max("attempt_number").alias("m"))
    return sections.where("id IS NOT NULL").select(F.col("id").alias("section_id")).distinct().join(m, "section_id", "left").select("section_id", F.coalesce("m", F.lit(0)).alias("latest"))


def digest(validations: DataFrame) -> DataFrame:
    """(report_id, digest): the ids of a report's facts by status, on four lines with the status padded to 14 characters."""
    ids = [F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("atomic_fact_id"))))).alias(s) for s in FACT_STATUS]
    g = validations.groupBy("report_id").agg(*ids)
    lines = [F.concat(F.lit("  "), F.rpad(F.lit(s.capitalize()), 14, " "), F.when(F.col(s) == "", "none").otherwise(F.col(s))) for s in FACT_STATUS]
    return g.select("report_id", F.concat_ws("\n", *lines).alias("digest"))


def facts_json(facts: DataFrame) -> DataFrame:
    """(section_id, facts): the facts of a section as the JSON array a model is asked to check, in order of creation and id."""
    f = facts.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", F.coalesce("point", F.lit("")).alias("point"), tier(F.col("rank")).alias("rank")))).alias("f"))
    return f.select("section_id", F.to_json(F.transform("f", lambda x: F.struct(x.id.alias("id"), x.point.alias("point"), x["rank"].alias("rank")))).alias("facts"))


SYSTEM = "You check whether a summary holds given facts. Answer with a JSON array with one object a fact, in the given order: fact_id, status (found, partial, missing or contradicted), evidence, confidence from 0 to 1, and improved, which is null at a first attempt."
USER = "Summary:\n{summary}\n\nFacts:\n{facts}\n\n{attempt}"
FIRST = "This is the first attempt."
LATER = "Attempt {number} scored {score}:\n{summary}\n\nThen these facts were\n{digest}"


def previous(summaries: DataFrame, reports: DataFrame, validations: DataFrame) -> DataFrame:
    """(id, section_id, attempt, previous_id, previous_text, previous_report, previous_score, digest) of each summary.

    The previous attempt of a section is the one before by time of submission and id; its report is that of the
    ``reports`` (report_id, summary_id, score), the greatest id if there are several, and ``digest`` that of its validations. All of
    them are null at the first attempt, the report's also if the previous summary has none. A summary delivered again counts once.
    """
    w = Window.partitionBy("section_id").orderBy("attempt")
    s = attempts(summaries.where("id IS NOT NULL").dropDuplicates(["id"])).select("id", "section_id", "attempt", "text")
    s = s.select("id", "section_id", "attempt", F.lag("id").over(w).alias("previous_id"), F.lag("text").over(w).alias("previous_text"))
    r = reports.where("report_id IS NOT NULL").groupBy(F.col("summary_id").alias("previous_id")).agg(F.max(F.struct("report_id", "score")).alias("r"))
    j = s.join(r, "previous_id", "left").select("id", "section_id", "attempt", "previous_id", "previous_text", F.col("r.report_id").alias("previous_report"), F.col("r.score").alias("previous_score"))
    return j.join(digest(validations).withColumnRenamed("report_id", "previous_report"), "previous_report", "left").select("id", "section_id", "attempt", "previous_id", "previous_text", "previous_report", "previous_score", "digest")


def validation_prompts(summaries: DataFrame, facts: DataFrame, before: DataFrame) -> DataFrame:
    """(id, section_id, system, user): what a model is asked about each summary (id, section_id, text) whose section has facts.

    ``before`` is the result of :func:`previous`: an attempt counts as the first unless the one before has a report. Scores
    are rounded to two places, half to even; null texts are empty.
    """
    b = before.select("id", F.col("attempt") - 1, F.coalesce("previous_text", F.lit("")), F.bround("previous_score", 2).cast("string"), "digest", F.col("previous_report").isNotNull()).toDF("id", "number", "old", "score", "digest", "later")
    j = summaries.where("id IS NOT NULL").dropDuplicates(["id"]).select("id", "section_id", F.coalesce("text", F.lit("")).alias("text")).join(facts_json(facts.where("section_id IS NOT NULL")), "section_id").join(b, "id", "left")
    later = F.coalesce("later", F.lit(False))
    none = "\n".join(f"  {s.capitalize():<14}none" for s in FACT_STATUS)
    attempt = F.when(later, filled(LATER, number=F.col("number").cast("string"), score=F.coalesce("score", F.lit("")), summary=F.col("old"), digest=F.coalesce("digest", F.lit(none)))).otherwise(F.lit(FIRST))
    return j.select("id", "section_id", F.lit(SYSTEM).alias("system"), filled(USER, attempt=attempt, facts=F.col("facts"), summary=F.col("text")).alias("user"))


def store(folder: str, summaries: DataFrame, reports: DataFrame, validations: DataFrame) -> None:
    """Add an audit to the tables ``summary``, ``report`` and ``validation`` of a folder, in this order, with the columns of their schemas; missing ones are null."""
    for name, df, schema in (("summary", summaries, SUMMARY), ("report", reports, REPORT), ("validation", validations, VALIDATION)):
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        append(df.select(*cols), f"{folder.rstrip('/')}/{name}")


def of_section(summaries: DataFrame, section_id: str) -> DataFrame:
    """Summaries of one section."""
    return summaries.where(F.col("section_id") == section_id)


def read_validations(replies: DataFrame) -> DataFrame:
    """(report_id, atomic_fact_id, status, evidence, confidence, improved) of replies (report_id, content).

    A reply is a list, or an object that holds one. Items without fact id or a known status, or with a confidence that is
    no number, are left out; a missing evidence is empty, a missing confidence 0.
    """
    keys = ("result", "results", "facts", "data", "items")
    r = lenient_json(replies, "v", keys=keys).select("report_id", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("x"))
    r = r.where(F.schema_of_variant("x").startswith("OBJECT"))
    get = lambda k, t: F.try_variant_get("x", f"$.{k}", t)
    out = r.select("report_id", get("fact_id", "string").alias("atomic_fact_id"), F.lower(get("status", "string")).alias("status"), F.coalesce(get("evidence", "string"), F.lit("")).alias("evidence"), F.when(get("confidence", "variant").isNull(), 0.0).otherwise(get("confidence", "double")).alias("confidence"), get("improved", "boolean").alias("improved"))
    return out.where(F.col("atomic_fact_id").isNotNull() & F.col("status").isin(*FACT_STATUS) & F.col("confidence").isNotNull())


def scores(reports: DataFrame, validations: DataFrame, facts: DataFrame, weighting: str = "as_built", confident: bool = True) -> DataFrame:
    """(report_id, score): the weighted share of what was found, in per cent.

    Found counts 1, partial one half, all else 0, times the confidence if ``confident``. Validations of unknown facts are
    left out, several of one fact all count, and a report without any scores 0. Sums are partial before the shuffle.
    """
    f = facts.where("id IS NOT NULL").groupBy("id").agg(F.min(tier(F.col("rank"))).alias("rank")).withColumnRenamed("id", "atomic_fact_id")
    w = weight(F.col("rank"), weighting).cast("double")
    acc = F.when(F.col("status") == "found", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    v = validations.join(f, "atomic_fact_id").select("report_id", w.alias("w"), (w * acc * (F.coalesce("confidence", F.lit(0.0)) if confident else F.lit(1.0))).alias("x"))
    v = v.groupBy("report_id").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    return reports.select("report_id").distinct().join(v, "report_id", "left").select("report_id", F.when(F.col("w") > 0, F.col("x") / F.col("w") * 100).otherwise(0.0).alias("score"))


def deltas(reports: DataFrame) -> DataFrame:
    """``reports`` (section_id, attempt, report_id, score) with ``score_delta``, the change against the attempt before; null at the first."""
    w = Window.partitionBy("section_id").orderBy("attempt", "report_id")
    return reports.withColumn("score_delta", F.col("score") - F.lag("score").over(w))


def feedback(validations: DataFrame, facts: DataFrame) -> DataFrame:
    """(report_id, atomic_fact_id, point, rank, status, evidence, confidence, message) of each validation.

    Facts that are unknown have an empty point and rank 3; a null evidence is empty. The message depends on rank and status.
    """
    f = facts.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("atomic_fact_id"), "point", tier(F.col("rank")).alias("rank"))
    j = validations.join(f, "atomic_fact_id", "left").withColumn("rank", F.coalesce("rank", F.lit(3)))
    return j.select("report_id", "atomic_fact_id", F.coalesce("point", F.lit("")).alias("point"), "rank", "status", F.coalesce("evidence", F.lit("")).alias("evidence"), "confidence", message(F.col("rank"), F.col("status")).alias("message"))


def message(rank: Column, status: Column) -> Column:
    """A sentence of feedback for a fact of some rank and status."""
    what = F.when(rank == 1, "a key point").when(rank == 2, "an important point").otherwise("a detail")
    return F.when(status == "found", F.concat(F.lit("You have "), what, F.lit("."))).when(status == "partial", F.concat(F.lit("You have part of "), what, F.lit("."))).when(status == "missing", F.concat(F.lit("You left out "), what, F.lit("."))).when(status == "contradicted", F.concat(F.lit("You got "), what, F.lit(" wrong.")))


def outcome(validations: DataFrame) -> DataFrame:
    """(report_id, mastered, partial, omissions, misconceptions): the sorted fact ids of a report by status."""
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("atomic_fact_id"))))
    return validations.groupBy("report_id").agg(pick("found").alias("mastered"), pick("partial").alias("partial"), pick("missing").alias("omissions"), pick("contradicted").alias("misconceptions"))


def history(reports: DataFrame, validations: DataFrame, facts: DataFrame) -> DataFrame:
    """(section_id, attempt, report_id, score, score_delta, n_facts, n_found) of each report (section_id, attempt, report_id, score).

    A missing attempt counts as 1; reports without validations stay.
    """
    v = feedback(validations, facts).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("status") == "found").alias("n_found"))
    r = deltas(reports.withColumn("attempt", F.coalesce("attempt", F.lit(1))))
    return r.join(v, "report_id", "left").select("section_id", "attempt", "report_id", "score", "score_delta", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def of_fact(validations: DataFrame, fact_id: str) -> DataFrame:
    """Validations of one fact."""
    return validations.where(F.col("atomic_fact_id") == fact_id)


def of_report(validations: DataFrame, report_id: str) -> DataFrame:
    """Validations of one report."""
    return validations.where(F.col("report_id") == report_id)
