"""Sentence boundaries in any script by a hidden-event n-gram model.

Between any two words stands either nothing or a hidden boundary token. For a gap with the token ``l`` on its left and the
word ``r`` on its right the model compares

    P(boundary | l) * P(r | start of a sentence)    with    P(no boundary | l) * P(r | l, sentence goes on).

Both probabilities of ``r`` are word n-grams: how often the word opens paragraphs, and how often it stands inside a
sentence, behind another word. The second one is a class n-gram: the kind of word that follows ``l`` when the sentence goes
on (a number, a small letter, a capital one ...), and the word given its kind. A gap behind a word without an end mark is
seen to be no boundary wherever the text has end marks at all, which is where the inner words are counted; the ends and
starts of paragraphs are boundaries that are seen. For the gaps between, behind an end mark, and in Thai at a space, the
model is fitted by expectation maximisation over counts of the whole corpus. Every token ``l`` has chances of its own; the less is
seen of it, the more they are those of its shape, so an abbreviation nobody listed is told by its shape and by the word behind it;
there is no list of abbreviations. Rare tokens are many, but most were seen in the same way: these are fitted as one, so many times.

A quotation that opens a sentence is another token than one inside it, so a decision depends on the one before:
forward-backward over the gaps of a paragraph gives the posteriors, and those above one half are boundaries. Marks inside
quotation marks or brackets are no gaps. Text without any end mark is the matter of :mod:`folio.llm.unmarked`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.common import reflowable_ids, slices, texts
from folio.session import cut, ship

#: Kinds of right token: the named ones, 58 buckets for the first character behind a quotation in scripts without case, and
#: from CAPITAL and CASELESS on the steps of the ratio between a word's frequencies at the start of and inside sentences.
RIGHT, CAPITAL, CASELESS, STEPS = 96, 64, 80, 16

# Marks.
END = ".!?…。！？．｡।॥؟۔։።"
OPEN_BRACKET, CLOSE_BRACKET = "([{（［【〔〈《", ")]}）］】〕〉》"
CLOSERS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‹": "›", "｢": "｣", '"': '"', **{a: b for a, b in zip(OPEN_BRACKET, CLOSE_BRACKET)}}
CLOSING = set("”“»«」』›｣\"") | set(CLOSE_BRACKET)

_TH = "฀-๿"
_MARKS = r"\n\s*\n|[" + re.escape(END) + r"]+|[" + re.escape("".join(set("".join(CLOSERS)) | CLOSING)) + "]"
_EVENT = re.compile(_MARKS)
_EVENT_TH = re.compile(_MARKS + rf"|(?<=[{_TH}0-9A-Za-z{re.escape(''.join(CLOSING))}])(?:[^\S\n]*\n?[^\S\n]+|\n)(?=\S)")
_THAI = re.compile(f"[{_TH}]")
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(f"[{re.escape(END)}]")
_BREAK = re.compile(r"\n\s*\n")
_REST = r"[^\W\d_a-zß-öø-ÿ][^\s.,;:!?…।॥؟،؛\"”“»«)(\]\[]*"
_WORD = re.compile(_REST)
_OPENING = re.compile(rf"[^\w]*({_REST})")
_INNER = re.compile(rf"(?<=[\w,;:–—-][ \n])({_REST})|(?<=[\u0600-\u06ff\u0900-\u0963][ \n])({_REST})")


def _group(ch: str) -> str:
    """The script of a character, as far as the model tells scripts apart."""
    o = ord(ch)
    if o < 0x590:
        return "L"
    if o < 0x900:
        return "R"
    if o < 0xE00:
        return "D"
    if o < 0xE80:
        return "T"
    if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or o >= 0x1F000:
        return "C"
    return "L"


GROUPS = "LRDTC"


def _right(text: str, at: int, quoted: bool, steps: Numbers | None = None) -> tuple[str, int]:
    """Kind of the token that begins at ``at``: its script and a number below RIGHT; ``steps`` are those of :func:`word_steps`."""
    ch = text[at]
    if ch in "¿¡" and at + 1 < len(text):
        at += 1
        ch = text[at]
    if ch.isdigit():
        return "", 0
    if ch.islower():
        return "L", 2
    if ch.isupper():
        return "L", 1 if text[at + 1 : at + 2] == "." else CAPITAL + _step(text, at, steps)
    if ch.isalpha() or ord(ch) >= 0x900 and not (ch in CLOSERS or ch in CLOSING):
        g = _group(ch)
        if quoted:
            return g, 6 + ord(ch) % 58
        return g, CASELESS + _step(text, at, steps) if g in "RD" else 3
    if ch in CLOSERS:
        return "", 4
    return "", 5


def key(word: str) -> int:
    """The number of a word or of a left token in the model: 64 bits, so that of ten million two share one with a chance of 3 in a million."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


class Numbers:
    """A small number for each of many words, by the words' 64-bit numbers; any other word has ``other``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: int):
        by = np.argsort(keys)
        self.keys, self.values, self.other = keys[by].astype(np.int64), values[by].astype(np.int8), other
        self._known: dict[str, int] = {}

    def __getitem__(self, at: int) -> int:
        i = int(self.keys.searchsorted(at))
        return int(self.values[i]) if i < len(self.keys) and self.keys[i] == at else self.other

    def __eq__(self, to) -> np.ndarray:
        return np.array([self.other == to.other, np.array_equal(self.keys, to.keys), np.array_equal(self.values, to.values)])

    def of(self, word: str, number=key) -> int:
        """What stands for a word; ``number`` gives the words' numbers."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 300_000:
                self._known.clear()
            got = self._known[word] = self[number(word)]
        return got


def _step(text: str, at: int, steps: Numbers | None) -> int:
    m = _WORD.match(text, at)
    return steps.of(m.group()) if m and steps is not None else STEPS // 2


@dataclass
class Paragraph:
    """A paragraph's place, its gaps, and what ends it."""

    start: int
    end: int
    first: int = 0
    gaps: list = field(default_factory=list)  # (end of the sentence before, left if the gap before is none, left if it is one, right)
    last: str = ""


def _kind(mark: str) -> str:
    if "!" in mark or "?" in mark or "؟" in mark or "！" in mark or "？" in mark:
        return "!"
    if "…" in mark or mark.count(".") > 1 or mark.count("。") > 1:
        return "~"
    return "." if mark[0] == "." else mark[0]


def _left(text: str, lo: int, at: int, mark: str, g: str) -> str:
    """The token before a gap that ends with ``mark`` at ``at``: script, kind of mark and, before a full stop, the word."""
    k = _kind(mark)
    if k != ".":
        return g + k
    j = at
    while j > lo and not text[j - 1].isspace():
        j -= 1
    w = text[j:at].lstrip("([{\"“„«‘'’—–-/")
    if not w:
        return g + "."
    if len(w) == 1 and w.isupper():
        return g + ".I"
    if w[0].isdigit() and w[-1].isdigit():
        return g + ".#"
    c = w[-1]
    if c in CLOSING:
        return g + ".)"
    return g + "." + w.lower()


#: Shapes of left tokens in one script: no word, words of 1 to 5 and of more letters, and words with a full stop inside; each
#: for words that are seen often without a full stop (a twentieth as often as with one), sometimes, and as good as never.
SHAPES = 24


def shape(left: str) -> int:
    """The number of a left token's script and length."""
    g = max(0, GROUPS.find(left[0]))
    w = left[2:] if left[1:2] == "." else ""
    if not w or w in ("I", "#", ")"):
        return g * 8
    return g * 8 + (7 if "." in w else min(len(w), 6))


def _shapes(length, bare, dotted):
    """Shapes of left tokens of some script and length, seen so often without and with a full stop."""
    return length // 8 * SHAPES + length % 8 * 3 + np.where((20 * bare > dotted) & (bare > 1), 0, np.where(200 * bare > dotted, 1, 2))


def paragraphs(text: str, steps: Numbers | None = None) -> Iterator[Paragraph]:
    """The paragraphs of a text with all gaps that may hold a boundary; ``steps`` are those of :func:`word_steps`."""
    n = len(text)
    events = list((_EVENT_TH if _THAI.search(text) else _EVENT).finditer(text))
    at, i = 0, 0
    while at < n:
        j = i
        while j < len(events) and text[events[j].start()] != "\n":
            j += 1
        brk = j < len(events) and len(events[j].group()) > 1 and "\n" in events[j].group()[1:]
        while j < len(events) and not brk:  # a single line break, as an event of Thai
            j += 1
            while j < len(events) and text[events[j].start()] != "\n":
                j += 1
            brk = j < len(events) and "\n" in events[j].group()[1:]
        stop = events[j].start() if j < len(events) else n
        a, b = at, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            p = _scan(text, a, b, events[i:j], None, steps)
            if p is None:
                p = _scan(text, a, b, events[i:j], _unmatched(text, events[i:j]), steps)
            yield p
        at, i = (events[j].end(), j + 1) if j < len(events) else (n, j)


def _unmatched(text: str, events: list) -> set[int]:
    """Places of opening marks that nothing in the paragraph closes."""
    stack: list[tuple[str, int]] = []
    for e in events:
        ch, s = text[e.start()], e.start()
        if ch in CLOSERS or ch in CLOSING:
            for d in range(len(stack) - 1, -1, -1):
                if ch in CLOSERS[stack[d][0]]:
                    del stack[d:]
                    break
            else:
                if ch in CLOSERS:
                    stack.append((ch, s))
    return {s for _, s in stack}


def _scan(text: str, a: int, b: int, events: list, skip: set[int] | None = None, steps: Numbers | None = None) -> Paragraph | None:
    """A paragraph's gaps; None if an opening mark stays open, unless the places of such marks are given."""
    p = Paragraph(a, b)
    stack: list[tuple[str, int]] = []  # closing marks awaited, and 0 within a sentence, 1 at its start, 2 after a colon
    mark, mark_at, mark_end = "", -1, -1  # the last end mark
    fresh = a  # where the sentence begins if the last gap is a boundary
    gaps = p.gaps
    for e in events:
        s, t = e.start(), e.end()
        if s < a or t > b:
            continue
        ch = text[s]
        if ch.isspace():
            if not stack and not (gaps and gaps[-1][0] == s):
                l, r = text[s - 1], text[t]
                # a space next to a numeral parts no sentences
                if l not in END and not l.isdigit() and not r.isdigit() and not (l in CLOSING and gaps and gaps[-1][4] == t):
                    left = "T" if _group(l) == "T" else "T)" if l in CLOSING else "Tx"
                    gaps.append((s, left, left, _right(text, t, False, steps), t))
                    fresh = t
            continue
        if ch in END:
            mark, mark_at, mark_end = e.group(), s, t
            if stack:
                continue
            end, how = t, -1
        else:
            if stack and ch in stack[-1][0]:
                how = stack.pop()[1]
            elif any(ch in x[0] for x in stack) and ch in CLOSING and ch not in CLOSERS:
                while stack:
                    c, how = stack.pop()
                    if ch in c:
                        break
            elif ch in CLOSERS and not (skip and s in skip):
                j = s - 1
                while j > a and text[j].isspace():
                    j -= 1
                stack.append((CLOSERS[ch], 1 if s == fresh else 2 if text[j] in ":：" else 0))
                continue
            else:
                continue
            if stack or mark_end < 0 or text[mark_end:s].strip():
                continue
            end = t
            mark_end = t  # another closing mark may follow
        nxt = end
        while nxt < b and text[nxt].isspace():
            nxt += 1
        if nxt >= b:
            break
        c = text[nxt]
        tight = nxt == end
        if c in CLOSING and c not in CLOSERS or c == '"' and tight and how < 0 and stack:
            continue
        if c in ",;:，；：、،؛）)":
            continue
        if tight and how < 0 and mark[0] in ".!?…" and _kind(mark) != "~":
            # no space: a boundary only between a small letter and a capital one, or letters without case
            before = text[mark_at - 1] if mark_at > a else " "
            if not (before.isalpha() and (c.isupper() and before.islower() or c.isalpha() and not c.isupper() and not c.islower() and mark_at > a + 2 and text[mark_at - 2].isalpha())):
                continue
        if tight and how < 0 and _kind(mark) == "~" and ord(mark[0]) < 0x80:
            continue
        word = text[mark_at - 1] if mark_at > a else c
        g = _group(word if word.isalpha() or ord(word) > 0x900 else c)
        if mark[0] > "\u0600" and mark[0] != "…":  # a mark of one script only
            g = _group(mark[0])
        r = _right(text, nxt, how >= 0, steps)
        if how < 0:
            left0 = left1 = _left(text, a, mark_at, mark, g)
        else:
            base = g + _kind(mark) + ch
            left0 = base + ("C" if how == 2 else "M")
            left1 = base + ("S" if how == 1 else "C" if how == 2 else "M")
        if gaps and gaps[-1][4] == nxt:  # the same gap, seen at an earlier mark of it
            gaps.pop()
        gaps.append((end, left0, left1, (r[0] or g, r[1]), nxt))
        fresh = nxt
    if stack and skip is None:
        return None
    tail = text[b - 1]
    if tail in END:
        j = b
        while j > a and text[j - 1] in END:
            j -= 1
        w = text[j - 1] if j > a and not ("\u0600" < text[j] != "…") else text[j]
        p.last = _left(text, a, j, text[j:b], _group(w))
    elif tail in CLOSING and mark_end == b:
        g = _group(text[mark_at - 1]) if mark_at > a else "L"
        p.last = g + _kind(mark) + tail + ("C" if how == 2 else "M" if how != 1 else "S" if fresh != a or gaps else "S")
    elif _group(tail) == "T":
        p.last = "T"
    elif tail in CLOSING and _THAI.search(text, a, b):
        p.last = "T)"
    return p


#: Marks that join as often as they end, whatever word they follow.
SPLIT = sorted({key(x + mark + c + how) for x in GROUPS for mark in "!.~。।" for c in CLOSING for how in "SM"} | {key(x + mark) for x in GROUPS for mark in (".#", ".I", "~")})


_WORDS = pa.schema([("g", pa.int8()), ("b", pa.int64()), ("start", pa.int64()), ("inside", pa.int64()), ("bare", pa.int64())])


_POWER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = 0xD6E8FEB86659FD93
#: Bytes of words (small letters and all that is no ASCII), and bytes behind words that have no full stop.
_IN_WORD = np.array([97 <= x <= 122 or x >= 128 for x in range(256)])
_BEHIND = np.array([x in b" \t\n,;:" for x in range(256)])


def _powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def bare_bucket(word: str) -> int:
    """The number of a word in the table of words without a full stop, 64 bits as those of :func:`key`, but such that all words of a text are numbered at once."""
    h = sum(b * pow(_POWER, i, 1 << 64) for i, b in enumerate(word.encode())) * _MIX % (1 << 64)
    return h - (h >> 63 << 64)


def bare_buckets(text: str) -> np.ndarray:
    """The numbers of all words of a text, in small letters, that have white space, a comma, a colon or a semicolon behind them."""
    b = np.frombuffer(text.lower().encode(), np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    inside = _IN_WORD[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lo, hi = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = hi < len(b)
    lo, hi = lo[keep], hi[keep]
    keep = _BEHIND[b[hi]]
    lo, hi = lo[keep], hi[keep]
    # sums of byte times power of its place, brought to the place 0
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * _powers(len(b), _POWER), out=total[1:])
    h = (total[hi] - total[lo]) * _powers(len(b), _INVERSE)[lo]
    return (h * np.uint64(_MIX)).view(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by number as one, each number once."""
    at, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return at, np.bincount(place, np.concatenate([n for _, n in parts]), len(at)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition by script and word: at the start of a paragraph of sentences, and inside sentences behind a word; by other numbers and without script: with no full stop behind it."""
    starts: Counter = Counter()
    inside: Counter = Counter()
    bare: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0  # numbers in there

    def flush():
        rows: dict[tuple[int, int], list[int]] = {}
        for k, c in enumerate((starts, inside)):
            for w, n in c.items():
                g = _group(w[0])
                if w[0].isupper() or g in "RD":
                    rows.setdefault((GROUPS.find(g), key(w)), [0, 0])[k] += n
            c.clear()
        cols = list(zip(*((*k, *v, 0) for k, v in rows.items()))) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _WORDS.types)], schema=_WORDS)

    def flush_bare():
        at, n = _summed(bare)
        bare.clear()
        none = pa.array(np.zeros(len(at), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, np.int8)), pa.array(at), none, none, pa.array(n)], schema=_WORDS)

    for batch in batches:
        for part in slices([batch], 200):
            now = part.column(0).to_pylist()
            bare.append(np.unique(bare_buckets("\n".join(now) + "\n"), return_counts=True))
            held += len(bare[-1][0])
            if held > 1_000_000:
                bare[:] = [_summed(bare)]
                held = len(bare[0][0])
                if held > 500_000:
                    yield flush_bare()
                    held = 0
            for text in now:
                for p in _BREAK.split(text):
                    p = p.strip()
                    if p and (p[-1] in END or p[-1] in CLOSING):
                        m = _OPENING.match(p)
                        if m:
                            starts[m.group(1)] += 1
                        inside.update(x or y for x, y in _INNER.findall(p))
        if len(starts) + len(inside) > 300_000:
            yield flush()
    yield flush()
    if bare:
        yield flush_bare()


@dataclass
class Words:
    """How words stand to the start of sentences: ``steps`` for each word, and P(step | start) and P(step | inside) by script.

    Steps of one half are those of the logarithm of P(word | start) / P(word | inside), with what is unknown in the middle.
    """

    steps: Numbers
    start: np.ndarray
    inside: np.ndarray
    bare: Numbers  # of each word the logarithm, to base 2, of how often it stands without a full stop

    @classmethod
    def of(cls, b: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Words:
        """From counts of words, by number: their script, or -1 for bare words, and how often they are at the start, inside, and bare."""
        k = len(GROUPS)
        bare = Numbers(b[g < 0], np.ceil(np.log2(z[g < 0] + 1.0)), 0)
        b, g, x, y = (c[g >= 0] for c in (b, g, x, y))
        s, m = np.bincount(g, x, k) + 1.0, np.bincount(g, y, k) + 1.0
        part = (s / (s + m))[g]

        def step(x, y):
            ratio = np.log((x + 3 * part) / (y + 3 * (1 - part))) - np.log(s / m)[g]
            return np.clip(np.floor(2 * ratio + 0.5) + STEPS // 2, 0, STEPS - 1).astype(np.int8)

        steps = Numbers(b, step(x, y), STEPS // 2)
        # an occurrence is judged by the others alone
        start, inside = np.zeros((k, STEPS)), np.zeros((k, STEPS))
        np.add.at(start, (g, step(np.maximum(x - 1, 0), y)), x)
        np.add.at(inside, (g, step(x, np.maximum(y - 1, 0))), y)
        start, inside = start + 0.05, inside + 0.05
        start, inside = start / start.sum(1, keepdims=True), inside / inside.sum(1, keepdims=True)
        # a word known from inside sentences may open one all the same
        return cls(steps, 0.95 * start + 0.05 * inside, inside, bare)


def word_steps(t: DataFrame) -> Words:
    """The words of (section_id, raw_text). Of each different word its number reaches the driver, and counts once for all words that were counted alike."""
    return words_of(t.select("raw_text").mapInArrow(count_words, "g byte, b long, start long, inside long, bare long"))


def words_of(counts: DataFrame) -> Words:
    """The words of rows of :func:`count_words`."""
    n = counts.groupBy("g", "b").agg(*(F.sum(c).alias(c) for c in ("start", "inside", "bare")))
    # a row has counts at the start and inside, or one of bare words, of which the bits tell the logarithm; most words are seen once, so these come in parts
    rows = n.groupBy("g", "start", "inside", F.length(F.bin("bare")).alias("bits"), F.pmod("b", F.lit(64)).alias("part")).agg(F.collect_list("b").alias("b")).toArrow()
    g, start, inside, bits, b = (rows.column(k).combine_chunks() for k in ("g", "start", "inside", "bits", "b"))
    of = np.repeat(np.arange(len(b)), b.value_lengths().to_numpy())
    return Words.of(b.flatten().to_numpy(), *(c.to_numpy()[of] for c in (g, start, inside)), 2.0 ** bits.to_numpy()[of] - 1)


_COUNTS = pa.schema([("kind", pa.int8()), ("s", pa.int8()), ("q", pa.int8()), ("l", pa.int64()), ("r", pa.int16()), ("n", pa.int64())])


def _bare(left: str, words: Words) -> int:
    return words.bare.of(left[2:], bare_bucket) if left[1:2] == "." and len(left) > 2 else 0


def count_gaps(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: gaps (kind 0) by left and right, paragraph ends (1) by left, paragraph starts (2) by right.

    Beside a left stand its script and length, and how often it is bare; a right is a kind, plus RIGHT times its script.
    """
    steps = words.steps
    gaps: Counter = Counter()
    ends: Counter = Counter()
    starts: Counter = Counter()

    def flush():
        merged: Counter = Counter()
        for (l, (g, r)), n in gaps.items():
            merged[0, shape(l), _bare(l, words), key(l), max(0, GROUPS.find(g)) * RIGHT + r] += n
        for l, n in ends.items():
            merged[1, shape(l), _bare(l, words), key(l), 0] += n
        for (g, r), n in starts.items():
            merged[2, 0, 0, 0, max(0, GROUPS.find(g)) * RIGHT + r] += n
        gaps.clear(), ends.clear(), starts.clear()
        cols = list(zip(*((*k, n) for k, n in merged.items()))) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _COUNTS.types)], schema=_COUNTS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for p in paragraphs(text, steps):
                for _, left0, left1, r, _ in p.gaps:
                    gaps[left1, r] += 1
                if p.last and p.gaps:  # titles and notices of one piece tell little about running text
                    ends[p.last] += 1
                    g, r = _right(text, p.start, False, steps)
                    starts[g or p.last[0], r] += 1
                    if r == 3 or r >= CASELESS:
                        starts[_right(text, p.start, True, steps)] += 1
        if len(gaps) + len(ends) > 500_000:
            yield flush()
    yield flush()


#: Of each kind of right token its class: the steps of a class are told apart by words alone, not by the token before.
_CLASS = np.array([CAPITAL if CAPITAL <= r < CASELESS else CASELESS if r >= CASELESS else r for r in range(RIGHT)])


class Model:
    """Probabilities of the hidden-event model, fitted to counts.

    ``e[l]`` is P(boundary | l), ``s[g, r]`` P(r | start of a sentence) in script g, and P(r | l, goes on) the product of
    the class of r among what follows l where no boundary is, smoothed with ``m[g, class]``, and P(r | class, inside).
    """

    GRID = np.array([0.003, 0.05, 0.2, 0.5, 0.8, 0.985])
    PRIOR = np.array([0.12, 0.03, 0.03, 0.03, 0.09, 0.7])
    BARE = np.array([2e-4, 1e-4, 1e-4, 1e-3, 1e-2, 1.0])
    PRIOR_SPLIT = np.array([0.4, 0.05, 0.05, 0.05, 0.05, 0.4])  # of a mark that joins as often as it ends

    #: Tokens differ in how often their sentences come last in a paragraph, and words in what follows them: beyond so many
    #: occurrences more of them tell nothing new, least of plain words, which notices repeat. Marks are the same whatever word they follow.
    TRUST_WORD, TRUST_SHORT, TRUST_MARK, TRUST_SCRIPT = 3, 12, 60, 240

    def __init__(self, counts: np.ndarray, words: Words, rounds: int = 8, tokens: tuple[np.ndarray, np.ndarray] | None = None):
        """``counts`` has the rows of :func:`count_gaps`: kind, script and length, bare, left, right, number.

        With ``tokens``, keys and beside each the left whose rows are its own as well, the rows of tokens that were seen in
        the same way are there only once, under one left; see :func:`alike`.
        """
        k = len(GROUPS)
        self.steps, self.words = words.steps, words
        counts = np.asarray(counts, np.int64).reshape(-1, 6)
        rows = counts[counts[:, 0] == 0]
        ends = counts[counts[:, 0] == 1]
        first = counts[counts[:, 0] == 2]
        seen, place = np.unique(np.concatenate([rows[:, 3], ends[:, 3]]), return_inverse=True)
        size = len(seen)
        l, l_end = place[: len(rows)], place[len(rows) :]
        keys, of_key = (seen, np.arange(size)) if tokens is None else (tokens[0], np.searchsorted(seen, tokens[1]))
        by = np.argsort(keys)
        self.lefts, self.places = keys[by], of_key[by].astype(np.int32)
        times = np.bincount(of_key, minlength=size).astype(float)  # how many tokens a left stands for
        n = rows[:, 5]
        g, r = rows[:, 4] // RIGHT, rows[:, 4] % RIGHT
        end = np.bincount(l_end, ends[:, 5], size).astype(float)
        starts = np.full((k, RIGHT), 0.02)
        np.add.at(starts, (first[:, 4] // RIGHT, first[:, 4] % RIGHT), first[:, 5])
        tot = end + np.bincount(l, n, size)
        for lo in (CAPITAL, CASELESS):
            starts[:, lo : lo + STEPS] = starts[:, lo : lo + STEPS].sum(1, keepdims=True) * words.start
        s = self._share(starts)
        # P(kind | class) inside sentences: seen for the steps, certain for the others
        within = np.ones((k, RIGHT))
        within[:, CAPITAL:CASELESS] = within[:, CASELESS:] = words.inside
        of = np.zeros(size, dtype=np.int64)  # shape of a left token
        for x, y in ((rows, l), (ends, l_end)):
            of[y] = _shapes(x[:, 1], 2.0 ** x[:, 2] - 1, tot[y])
        script = of // SHAPES
        all_end, all_tot = end * times, tot * times
        # share of boundaries that end a paragraph, by script: that of the token in the middle, weighted by occurrences
        rho = np.clip((np.bincount(script, all_end, k) + 1) / (np.bincount(script, all_tot, k) + 4), 0.02, 0.9)
        for x in range(k):
            own = np.nonzero((script == x) & (tot >= 10))[0]
            if all_tot[own].sum() >= 50:
                share = end[own] / tot[own]
                by = np.argsort(share)
                rho[x] = np.clip(share[by][np.searchsorted(np.cumsum(all_tot[own][by]), all_tot[own].sum() / 2)], 0.02, 0.9)
        is_split = np.zeros(size, bool)
        is_split[of_key[np.isin(keys, SPLIT)]] = True
        # short words that are never seen without a full stop may well be abbreviations, longer ones often seen without one are none
        base = np.tile(3 * self.PRIOR, (k * SHAPES, 1))
        base[[x for x in range(k * SHAPES) if x % 3 == 2 and x % SHAPES // 3 in (1, 2, 3, 4, 7)]] = self.PRIOR_SPLIT
        plain = [x for x in range(k * SHAPES) if x % 3 == 0 and x % SHAPES >= 6]
        base[plain] = self.BARE
        prior = base / base.sum(1, keepdims=True)
        word = of % SHAPES >= 3
        weight = np.minimum(1.0, np.where(word & (of % 3 == 2), self.TRUST_SHORT, self.TRUST_WORD) / np.maximum(tot, 1))
        weight_end = np.minimum(1.0, np.where(word, self.TRUST_WORD, self.TRUST_MARK) / np.maximum(tot, 1))
        # a script in which words with a full stop end no paragraphs has another mark for the ends of sentences
        stopped = np.zeros((k, len(self.GRID)))
        for x in range(k):
            own = (script == x) & word & (tot > 0)
            t, z = all_tot[own].sum(), all_end[own].sum()
            p = np.minimum(rho[x] * self.GRID, 0.999)
            of_all = min(1.0, self.TRUST_SCRIPT / max(t, 1)) * (z * np.log(p) + (t - z) * np.log1p(-p))
            stopped[x] = np.minimum(of_all - of_all[0], 0)
        group, cell = np.unique(l * RIGHT + _CLASS[r], return_inverse=True)  # (token, class)
        of_group = group // RIGHT
        # what goes on behind a token is known well only if it is more than a small part of what stands there
        few = 2 + 0.1 * tot
        m = np.full((k, 2, RIGHT), 1.0 / RIGHT)
        after_word = word.astype(np.int64)
        e = np.full(size, float(self.PRIOR @ self.GRID))
        # at first what goes on is taken to be what is beyond the starts of sentences
        gap_n = np.bincount(l, n, size)
        rest = np.maximum(n - gap_n[l] * 0.8 * s[g, r], 0.1 * n)
        for _ in range(rounds):
            rest_l = np.bincount(l, rest, size)
            rest_c = np.bincount(cell, rest, len(group))
            on_c = (rest_c + few[of_group] * m[script[of_group], after_word[of_group], group % RIGHT]) / (rest_l[of_group] + few[of_group])
            on = on_c[cell] * within[g, r]
            ll = np.log(prior[of])
            ll[is_split] = np.log(self.PRIOR_SPLIT)
            ll[word] += stopped[script[word]]
            # an occurrence that ends a paragraph is seen to be a boundary; among those that don't, boundaries are rarer
            for q, x in enumerate(self.GRID):
                p = np.minimum(rho[script] * x, 0.999)
                ll[:, q] += weight_end * (end * np.log(p) + (tot - end) * np.log1p(-p))
                i = x * (1 - rho[g]) / (x * (1 - rho[g]) + 1 - x)
                ll[:, q] += np.bincount(l, weight[l] * n * np.log(i * s[g, r] + (1 - i) * on), size)
            w = np.exp(ll - ll.max(1, keepdims=True, initial=-np.inf))
            w /= w.sum(1, keepdims=True)
            e = w @ self.GRID
            # the shapes' chances are those of their tokens that are no rarities
            often = (tot >= 5) & ~is_split
            held = np.zeros_like(prior)
            np.add.at(held, of[often], w[often] * times[often, None])
            held[plain] = 0
            prior = (held + base) / (held.sum(1, keepdims=True) + base.sum(1, keepdims=True))
            i = e[l] * (1 - rho[g]) / np.maximum(1e-9, e[l] * (1 - rho[g]) + 1 - e[l])
            pb, pn = i * s[g, r], (1 - i) * on
            p = pb / np.maximum(pb + pn, 1e-300)
            rest = n * (1 - p)
            more = np.full((k, 2, RIGHT), 0.02)
            np.add.at(more, (script[l], after_word[l], _CLASS[r]), rest * times[l])
            m = more / more.sum(2, keepdims=True)
            # sentences inside paragraphs start as paragraphs do, but for those that follow a quotation
            both = starts.copy()
            np.add.at(both, (g, r), n * p * times[l])
            s = self._share(both)
        self.s, self.m, self.rho, self.within = s, m, rho, within
        self.e = e.astype(np.float32)
        self.shaped = self._shaped(prior, stopped)
        self.keys, self.on = group.astype(np.int64), on_c.astype(np.float32) if len(rows) else np.zeros(0, np.float32)
        self.rest, self.few = rest_l.astype(np.float32), few.astype(np.float32)
        self._known: dict = {}

    @classmethod
    def _shaped(cls, prior: np.ndarray, stopped: np.ndarray) -> np.ndarray:
        """P(boundary) of tokens of which only the shape is known."""
        w = prior.copy()
        word = np.arange(len(w)) % SHAPES >= 3
        w[word] *= np.exp(np.repeat(stopped, SHAPES, 0)[word])
        return w @ cls.GRID / w.sum(1)

    @staticmethod
    def _share(starts: np.ndarray) -> np.ndarray:
        """Counts of starts as shares, apart for what follows a quotation and what doesn't."""
        out = starts.copy()
        after = out[:, 6:CAPITAL]
        rest = out.sum(1, keepdims=True) - after.sum(1, keepdims=True)
        out[:, 6:CAPITAL] = after / after.sum(1, keepdims=True)
        out[:, :6] /= rest
        out[:, CAPITAL:] /= rest
        return out

    def place(self, left: str) -> int:
        """The place of a left token among the fitted ones, or -1 if the texts have none."""
        x = key(left)
        i = int(np.searchsorted(self.lefts, x))
        return int(self.places[i]) if i < len(self.lefts) and self.lefts[i] == x else -1

    def scores(self, left: str, right: tuple[str, int]) -> tuple[float, float]:
        """Weights of a boundary and of none in a gap."""
        gap = (left, right)
        got = self._known.get(gap)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            b, g, r = self.place(left), max(0, GROUPS.find(right[0] or left[0])), right[1]
            c = int(_CLASS[r])
            on = float(self.m[max(0, GROUPS.find(left[0])), int(shape(left) % 8 > 0), c])
            if b < 0:  # a token that no text has
                e = float(self.shaped[_shapes(shape(left), 2.0 ** _bare(left, self.words) - 1, 0)])
            else:
                e, k = float(self.e[b]), b * RIGHT + c
                i = int(np.searchsorted(self.keys, k))
                on = float(self.on[i]) if i < len(self.keys) and self.keys[i] == k else on * float(self.few[b] / (self.rest[b] + self.few[b]))
            on *= float(self.within[g, r])
            rho = float(self.rho[g])
            inner = e * (1 - rho) / max(1e-9, e * (1 - rho) + 1 - e)
            got = self._known[gap] = (max(inner * float(self.s[g, r]), 1e-12), max((1 - inner) * on, 1e-12))
        return got

    def posteriors(self, p: Paragraph) -> list[float]:
        """P(boundary) of each gap of a paragraph, by the forward-backward algorithm."""
        n = len(p.gaps)
        w1 = [self.scores(x[2], x[3]) for x in p.gaps]
        if all(x[1] == x[2] for x in p.gaps):
            return [b / (b + c) for b, c in w1]
        w0 = [y if x[1] == x[2] else self.scores(x[1], x[3]) for x, y in zip(p.gaps, w1)]
        fwd: list[tuple[float, float]] = []
        none, bound = 0.0, 1.0  # a paragraph begins like a sentence
        for (b0, n0), (b1, n1) in zip(w0, w1):
            nb, nn = none * b0 + bound * b1, none * n0 + bound * n1
            z = nb + nn
            none, bound = nn / z, nb / z
            fwd.append((none, bound))
        out = [0.0] * n
        back0 = back1 = 1.0
        for i in range(n - 1, -1, -1):
            f0, f1 = fwd[i]
            out[i] = f1 * back1 / (f0 * back0 + f1 * back1)
            (b0, n0), (b1, n1) = w0[i], w1[i]
            back0, back1 = b0 * back1 + n0 * back0, b1 * back1 + n1 * back0
            z = back0 + back1
            back0, back1 = back0 / z, back1 / z
        return out

    def spans(self, text: str, unmarked=None) -> list[tuple[int, int]]:
        """Places of the sentences of a text; pieces without a letter are left out.

        A paragraph without any end mark is one sentence, or what ``unmarked`` cuts it into: the model of :mod:`folio.llm.unmarked`.
        """
        out = []
        for p in paragraphs(text, self.steps):
            at = p.start
            if unmarked is not None and not p.gaps and not _ENDS.search(text, p.start, p.end):
                out += [x for x in unmarked.cut(text, p.start, p.end) if _LETTER.search(text, *x)]
                continue
            if p.gaps:
                for (end, _, _, _, nxt), q in zip(p.gaps, self.posteriors(p)):
                    if q > 0.5:
                        if _LETTER.search(text, at, end):
                            out.append((at, end))
                        at = nxt
            if _LETTER.search(text, at, p.end):
                out.append((at, p.end))
        return out


def alike(counts: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The rows of :func:`count_gaps`, summed, with those of left tokens that were seen in the same way once, and their tokens, for :class:`Model`.

    Tokens of one shape, equally bare and with equal counts before the same words get the same chances in every round, so
    nothing is lost. Of a token only its key reaches the driver; ways to be seen grow far more slowly than rare tokens do.
    """
    first = counts.where("kind = 2").select("kind", "s", "q", "l", "r", "n").toArrow()
    seen = counts.where("kind < 2").groupBy("l", "s", "q").agg(F.array_sort(F.collect_list(F.struct("kind", "r", "n"))).alias("x"))
    seen = seen.groupBy("s", "q", "x", F.col("l").isin(SPLIT).alias("split")).agg(F.collect_list("l").alias("keys"))
    # in one order, so that sums come out the same in every run
    seen = seen.select("s", "q", "x", "keys", F.array_min("keys").alias("least")).toArrow().sort_by("least")
    s, q, x, keys = (seen.column(k).combine_chunks() for k in range(4))
    rows, lefts = x.flatten(), np.arange(len(seen))
    own, many = (np.repeat(lefts, v.value_lengths().to_numpy()) for v in (x, keys))
    of = [rows.field("kind").to_numpy(), s.to_numpy()[own], q.to_numpy()[own], own, rows.field("r").to_numpy(), rows.field("n").to_numpy()]
    starts = np.column_stack([c.to_numpy() for c in first.columns]).astype(np.int64)
    return np.concatenate([np.column_stack(of).astype(np.int64), starts]), (keys.flatten().to_numpy(), many)


def fit(sections: DataFrame) -> Model:
    """The model of all texts. What reaches the driver are 8 bytes of each word and of each left token, and the ways in which these were seen."""
    spark = sections.sparkSession
    ship(spark)
    t = texts(sections)
    words = word_steps(t)
    shared = spark.sparkContext.broadcast(words)
    counts = t.select("raw_text").mapInArrow(lambda batches: count_gaps(batches, shared.value), "kind byte, s byte, q byte, l long, r short, n long")
    rows, tokens = alike(cut(counts.groupBy("kind", "s", "q", "l", "r").agg(F.sum("n").alias("n"))))
    return Model(rows, words, tokens=tokens)


def split_sections(t: DataFrame, model: Model, unmarked=None) -> DataFrame:
    """(section_id, starts, ends) of each row of (section_id, raw_text)."""
    shared = t.sparkSession.sparkContext.broadcast((model, unmarked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, other = shared.value
        for batch in batches:
            starts, ends, offsets = [], [], [0]
            for text in batch.column(1).to_pylist():
                spans = m.spans(text, other)
                starts += [x[0] for x in spans]
                ends += [x[1] for x in spans]
                offsets.append(len(starts))
            o = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(o, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(o, pa.array(ends, pa.int32()))], names=["section_id", "starts", "ends"])

    return t.select("section_id", "raw_text").mapInArrow(run, "section_id string, starts array<int>, ends array<int>")


def sentences(sections: DataFrame, toc: DataFrame | None = None, model: Model | None = None, unmarked=None) -> DataFrame:
    """(section_id, sentence_no, start_char, end_char) of every section that is not blank.

    With ``toc`` only reflowable sections count. Null ids and null or blank texts give no rows, a section delivered again
    counts once. A paragraph without an end mark is one sentence, unless ``unmarked``, a fitted model of
    :mod:`folio.llm.unmarked`, cuts it between words. Empty tables give an empty result.
    """
    model = model or fit(sections)
    cut_up = split_sections(texts(sections), model, unmarked)
    if toc is not None:
        cut_up = cut_up.join(reflowable_ids(toc), "section_id", "left_semi")
    cut_up = cut_up.dropDuplicates(["section_id"])
    return cut_up.select("section_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("no", "x")).select("section_id", (F.col("no") + 1).alias("sentence_no"), F.col("x.starts").alias("start_char"), F.col("x.ends").alias("end_char"))
