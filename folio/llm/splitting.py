"""Splitting oversized texts at natural boundaries with an overlap between pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.common import reflowable_ids, texts
from folio.llm.sentences import Model, fit
from folio.session import ship

#: From coarse to fine.
LEVELS = ("section", "paragraph", "sentence", "word", "character")

_PARAGRAPH = re.compile(r"\S(?:(?!\n\s*\n)[\s\S])*")
_WORD = re.compile(r"\S+")


def _units(text: str, a: int, b: int, level: str, model: Model) -> list[tuple[int, int, int]]:
    """The units of one level in ``text[a:b]``, without white space around them, and the length of each.

    What holds no letter, such as a row of stars, stays with the sentence before it but doesn't count as part of it.
    """
    if level == "paragraph":
        got = [(m.start(), m.start() + len(m.group().rstrip())) for m in _PARAGRAPH.finditer(text, a, b)]
    elif level == "sentence":
        own = [(a + x, a + y) for x, y in model.spans(text[a:b])]
        if not own:
            return [(a, b, 0)]
        ends = [x for x, _ in own[1:]] + [b]
        return [(a if k == 0 else x, x + len(text[x:e].rstrip()), y - x) for k, ((x, y), e) in enumerate(zip(own, ends))]
    elif level == "word":
        got = [m.span() for m in _WORD.finditer(text, a, b)]
    else:
        got = [(k, k + 1) for k in range(a, b)]
    return [(x, y, y - x) for x, y in got if y > x]


def split_text(text: str, limit: int, overlap: int, model: Model) -> tuple[str, list[tuple[int, int, int]]]:
    """The boundary of a text, and (start, end, overlap) of its pieces in order; see :func:`split`.

    The recursion divides a unit that doesn't fit into units of the next level. How deep units longer than the limit make
    it go is the boundary: all units of that level fit, and of the level above it one doesn't.
    """
    a, b = 0, len(text)
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    deepest = int(len(text) > limit)
    if a == b:
        return LEVELS[deepest], []
    if b - a <= limit:
        return LEVELS[deepest], [(a, b, 0)]
    pieces: list[tuple[int, int, int]] = []
    start, end = a, a  # of the piece at work; end == its last unit's end

    def close():
        nonlocal start
        pieces.append((start, end, 0 if not pieces else pieces[-1][1] - start))
        start = max(a, end - overlap)

    def characters(x: int, y: int) -> None:
        nonlocal end
        if x - start >= limit:
            x = end  # the white space before is too long to pass over
        while x < y:
            room = start + limit - x
            if room <= 0:
                close()
                continue
            end = x = min(y, x + room)
            if x < y:
                close()

    def descend(x: int, y: int, length: int, level: int) -> None:
        nonlocal end, deepest
        if length > limit:
            deepest = max(deepest, level + 1)
        if y - start <= limit:
            end = y
            return
        if end - start > overlap and end > (pieces[-1][1] if pieces else a):  # else there is too little for the overlap
            close()
            if y - start <= limit:
                end = y
                return
        if LEVELS[level + 1] == "character":
            characters(x, y)
            return
        for u, v, n in _units(text, x, y, LEVELS[level + 1], model):
            descend(u, v, n, level + 1)

    descend(a, b, b - a, 0)
    if end > (pieces[-1][1] if pieces else a):
        close()
    return LEVELS[deepest], pieces


def split(sections: DataFrame, limit: int = 4000, overlap: int = 200, model: Model | None = None, longer_than: int = 0) -> DataFrame:
    """(section_id, boundary, piece_no, start_char, end_char, overlap, text): the pieces of every section that is not blank.

    A text longer than ``limit`` code points is divided by paragraph, what doesn't fit of these by sentence, word and at
    last character. Units are packed greedily. Each piece but the first begins exactly ``overlap`` code points before the
    end of the one before, so a unit that fits the limit but not with the overlap is divided further. Without overlaps the
    pieces give the text back, trimmed. ``boundary`` is the level down to which units longer than the limit made the
    recursion go: the coarsest one all of whose units fit.

    Null ids and null or blank texts give no rows; a section delivered again counts once; ``longer_than`` keeps only
    longer texts. Empty tables give an empty result. The limit must exceed the overlap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the limit must exceed the overlap")
    spark = sections.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or fit(sections))
    piece = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("overlap", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            got = [split_text(t, limit, overlap, m) for t in raw]
            made = [[{"start_char": a, "end_char": b, "overlap": o, "text": t[a:b]} for a, b, o in x] for t, (_, x) in zip(raw, got)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array(made, piece)], names=["section_id", "boundary", "pieces"])

    t = texts(sections)
    if longer_than:
        t = t.where(F.length("raw_text") > longer_than)
    got = t.dropDuplicates(["section_id"]).mapInArrow(run, "section_id string, boundary string, pieces array<struct<start_char:int,end_char:int,overlap:int,text:string>>")
    return got.select("section_id", "boundary", F.posexplode("pieces").alias("no", "p")).select("section_id", "boundary", (F.col("no") + 1).alias("piece_no"), "p.*")


def oversized(sections: DataFrame, toc: DataFrame, limit: int = 4000, overlap: int = 200, model: Model | None = None) -> DataFrame:
    """(section_id, boundary) of the reflowable sections longer than ``limit``, from their pieces."""
    wide = sections.where(F.length("raw_text") > limit)
    pieces = split(wide.join(reflowable_ids(toc).withColumnRenamed("section_id", "id"), "id", "left_semi"), limit, overlap, model or fit(sections), limit)
    return pieces.where("piece_no = 1").select("section_id", "boundary")
