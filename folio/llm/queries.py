"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import boilerplate, mixing, neardup, packing, scans, sentences, sizes, spam, splitting, unmarked
from folio.session import stored, table


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "sections"), table(spark, d, "toc_entries"), table(spark, d, "books"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise on the lines of scanned sections."""
    return _repaired(spark, d).select("section_id", F.explode("found").alias("x")).select("section_id", "x.line_no", "x.noise")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned sections as continuous paragraphs."""
    return _repaired(spark, d).select("section_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the reflowable sections."""
    return sentences.sentences(table(spark, d, "sections"), table(spark, d, "toc_entries"))


def p2_all(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every section, those of text without end marks as well."""
    s = table(spark, d, "sections")
    model = sentences.fit(s)
    return sentences.sentences(s, model=model, unmarked=unmarked.fit(s, model))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Reflowable sections too long for one piece, with the unit they divide at."""
    return splitting.oversized(table(spark, d, "sections"), table(spark, d, "toc_entries"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every section."""
    return splitting.split(table(spark, d, "sections"))


def _similar(spark: SparkSession, d: str, collect) -> DataFrame:
    """What ``collect`` makes of the similar section texts and of the similar titles, under their field."""
    out = None
    for field, name, col, how in (("text", "sections", "raw_text", neardup.TEXT), ("title", "toc_entries", "title", neardup.TITLE)):
        got = collect(*neardup.similar(table(spark, d, name), "id", col, **how))
        got = got.select(F.lit(field).alias("field"), *got.columns)
        out = got if out is None else out.union(got)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of edited copies among section texts and among titles."""
    return _similar(spark, d, neardup.expand)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of copies of each section and of each toc row, and the links of its text or title."""
    return _similar(spark, d, neardup.groups)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated across a book's sections."""
    return boilerplate.repeated_lines(table(spark, d, "sections"), table(spark, d, "toc_entries")).select("section_id", "line_no").distinct()


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of repeated lines of each book."""
    return boilerplate.blocks(boilerplate.repeated_lines(table(spark, d, "sections"), table(spark, d, "toc_entries")))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every section without its repeated lines."""
    return boilerplate.without_repeated_lines(table(spark, d, "sections"), table(spark, d, "toc_entries"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    # tokens are counted once; what follows reads them several times
    return packing.pack(stored(sizes.token_counts(table(spark, d, "documents"))), table(spark, d, "pack_sizes"))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    """The bin of each document in each pack."""
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the bins of each pack are filled."""
    return packing.report(_packed(spark, d), table(spark, d, "pack_sizes"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(sizes.token_counts(table(spark, d, "documents"), None, "source"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: shard, position and copy of each document."""
    return _mixture(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source contributes to the mixture."""
    return mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of spam."""
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_all": p2_all, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_blocks": p5_blocks, "p5_cleaned": p5_cleaned, "p6_packs": p6_packs, "p6_fill": p6_fill, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found}

_P5 = r"""
WITH m AS (SELECT DISTINCT book_id, section_id FROM toc_entries WHERE book_id IS NOT NULL AND section_id IS NOT NULL),
s AS (SELECT id AS section_id, any_value(raw_text) AS raw_text FROM sections WHERE id IS NOT NULL AND regexp_matches(raw_text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]') GROUP BY id),
l AS (SELECT section_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS t FROM (SELECT section_id, string_split(raw_text, chr(10)) AS a FROM s)),
f AS (SELECT section_id, line_no, trim(regexp_replace(regexp_replace(lower(t), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS t FROM l WHERE regexp_matches(t, '\p{L}')),
n AS (SELECT book_id, count(*) AS n FROM m JOIN s USING (section_id) GROUP BY book_id),
k AS (SELECT book_id, t FROM m JOIN f USING (section_id) JOIN n USING (book_id) GROUP BY book_id, t, n HAVING count(DISTINCT section_id) >= 5 AND count(DISTINCT section_id) >= 0.2 * n),
found AS (SELECT DISTINCT section_id, line_no FROM m JOIN f USING (section_id) JOIN k USING (book_id, t))
"""
SQL = {
    "p5_found": _P5 + "SELECT section_id, line_no FROM found",
    "p5_cleaned": _P5 + """, o AS (SELECT id AS section_id, any_value(raw_text) AS raw_text FROM sections WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT section_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS t FROM (SELECT section_id, string_split(raw_text, chr(10)) AS a FROM o))
SELECT o.section_id, CASE WHEN o.raw_text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text FROM o
LEFT JOIN (SELECT section_id, string_agg(t, chr(10) ORDER BY line_no) AS text FROM p ANTI JOIN found USING (section_id, line_no) GROUP BY section_id) x USING (section_id)""",
}
