"""Repair of text from scanned pages by a noisy channel.

The source model is an n-gram model of the whole corpus: word and word-pair counts, hashed into tables of fixed size.
The channel turns characters into others with the probabilities of a confusion table, whose rates are re-estimated from
the scanned pages themselves. For each line of running text the candidates of its words, found by undoing confusions,
form a lattice that is decoded by the Viterbi algorithm. Page numbers and running titles are set apart first, and words
divided at line ends are joined when the counts say that the hyphen doesn't belong to the word.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.common import clean_ids, scanned_ids, texts
from folio.session import cut, ship

#: Bits of the two word tables and of the table of word pairs: what the driver and the executors hold.
WORD_BITS, PAIR_BITS = 20, 23
#: Quantisation of logarithms of counts.
STEP = 8.0
#: How many readings of a word's marks are followed side by side, the likeliest; all of them for up to four marks.
BEAM = 256
#: How many confusions of letters are undone in a word, beside all its marks.
LETTERS = 2
#: What is longer is in no dictionary and stays as it is.
LONGEST = 80

# What a scan shows, and what the page had.
CONFUSIONS = r"""
c e, 0 o, 1 l, 5 s, 9 g, 6 b, 6 é, 6 ó, 6 ö, 8 b, @ a, @ á, + t, ! i, ! í, | l, ·
ri n, ii u, ii ü, ii n, cl d, li h, rn m, m rn, \/ v, vv w, lc k
"""
CONFUSIONS = [tuple((x.strip() + " ").split(" ")[:2]) for x in CONFUSIONS.replace("\n", ",").split(",") if x.strip()]
# Marks that a scan puts at the end of a divided word.
BREAKS = "-­¬‐‑"
SOFT = "­¬‐"

_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)*")
_EDGE = ".,;:?\"“”„«»()[]{}'’‘…–—*•¿¡‹›"
_NUMBER = re.compile(r"[\W_]*(?:(?:page|seite|página|pagina|pág|pag|p|s)\b\.?)?[\W_]*?([0-9lIoOiSBZ|!]{1,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})[\W_]*", re.I)
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", re.I)
_INWARD = re.compile(r"[^\W\d_]")


def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_COUNTS = pa.schema([("t", pa.int8()), ("b", pa.int32()), ("n", pa.int64())])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of one partition: words (tables 0 and 1), pairs of words (2), and the number of words (3)."""
    wm, pm = (1 << WORD_BITS) - 1, (1 << PAIR_BITS) - 1
    words, pairs = np.zeros((2, wm + 1), np.int64), np.zeros(pm + 1, np.int64)
    total, known, waiting = 0, {}, []

    def take():
        nonlocal total
        ids = np.fromiter(waiting, np.uint64, len(waiting))
        waiting.clear()
        real = ids[ids > 0]
        total += len(real)
        words[0] += np.bincount((real & wm).astype(np.int64), minlength=wm + 1)
        words[1] += np.bincount((_second(real) & wm).astype(np.int64), minlength=wm + 1)
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        pairs[:] += np.bincount((_pair(ids[:-1][both], ids[1:][both]) & pm).astype(np.int64), minlength=pm + 1)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not _LATIN.search(text):
                continue
            for w in _words(text):
                i = known.get(w)
                if i is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    i = known[w] = _crc(w) | 1 << 32
                waiting.append(i)
            waiting.append(0)
            if len(waiting) > 2_000_000:
                take()
    take()
    for t, x in ((0, words[0]), (1, words[1]), (2, pairs), (3, np.array([total]))):
        at = np.nonzero(x)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int8)), pa.array(at.astype(np.int32)), pa.array(x[at])], schema=_COUNTS)


def _second(ids):
    return (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _pair(a, b):
    return (a * np.uint64(0xC2B2AE3D27D4EB4F) ^ b * np.uint64(0x165667B19E3779F9)) >> np.uint64(37)


class Source:
    """The n-gram model: logarithms of counts in hashed tables, and the number of words."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, total: int):
        self.words, self.pairs, self.total = words, pairs, max(total, 1)
        self.least = max(4.0, 1e-6 * total)  # count from which a word is a dictionary word

    def count(self, word: str) -> float:
        """About how often the word occurs in the corpus."""
        i = _crc(word) | 1 << 32
        a = i & ((1 << WORD_BITS) - 1)
        b = ((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 40 & ((1 << WORD_BITS) - 1)
        q = min(self.words[0, a], self.words[1, b])
        return math.expm1(q / STEP)

    def pair(self, a: str, b: str) -> float:
        """About how often ``b`` follows ``a``."""
        x, y = _crc(a) | 1 << 32, _crc(b) | 1 << 32
        h = ((x * 0xC2B2AE3D27D4EB4F) ^ (y * 0x165667B19E3779F9)) & 0xFFFFFFFFFFFFFFFF
        return math.expm1(self.pairs[h >> 37 & ((1 << PAIR_BITS) - 1)] / STEP)


def fit_source(sections: DataFrame) -> Source:
    """The n-gram model of all texts; what reaches the driver is bounded by the sizes of the tables."""
    ship(sections.sparkSession)
    n = texts(sections).select("raw_text").mapInArrow(count_words, "t byte, b int, n long").groupBy("t", "b").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("t") == 3, F.col("n")))
    q = F.least(F.lit(255.0), F.round(F.log1p("n") * STEP)).cast("short")
    # chunks of 4096 buckets, so that the tables come as a few arrays and not as millions of rows
    rows = n.groupBy("t", F.shiftright("b", 12).alias("chunk")).agg(F.collect_list(F.struct(F.col("b").bitwiseAND(4095).cast("short").alias("o"), q.alias("q"))).alias("x"), total.alias("total")).toArrow()
    words, pairs, count = np.zeros((2, 1 << WORD_BITS), np.uint8), np.zeros(1 << PAIR_BITS, np.uint8), 0
    for t, chunk, x, n_words in zip(*(rows.column(k) for k in range(4))):
        if t.as_py() == 3:
            count += n_words.as_py()
            continue
        to = pairs if t.as_py() == 2 else words[t.as_py()]
        own = x.values
        to[(chunk.as_py() << 12) + own.field("o").to_numpy().astype(np.int64)] = own.field("q").to_numpy()
    return Source(words, pairs, count)


class Channel:
    """Candidates of a word and the logarithms of their probabilities given what the scan shows."""

    UNSEEN = -30.0

    def __init__(self, source: Source, rates: dict[tuple[str, str], float] | None = None):
        self.source = source
        self.rates = rates or {c: 3e-4 for c in CONFUSIONS}
        self.undo: dict[str, list[tuple[str, float]]] = {}
        for c in CONFUSIONS:
            self.undo.setdefault(c[0], []).append((c[1], math.log(self.rates[c])))
        self._seen: dict[str, list] = {}

    def _sites(self, word: str, lo: int = 0) -> list[tuple[int, int, str, float, tuple[str, str]]]:
        """Where letters from ``lo`` on may be misread: begin, end, what was there, log rate, confusion."""
        undo, out = self.undo, []
        for i in range(lo, len(word)):
            for k in (1, 2):
                for true, lp in undo.get(word[i : i + k], ()):
                    if i + k <= len(word) and word[i : i + k].isalpha():
                        out.append((i, i + k, true, lp, (word[i : i + k], true)))
        return out

    def _letters_only(self, shown: str) -> list[tuple[str, float, tuple]]:
        """``shown`` with each mark that no word has replaced by what a scan may have read as it."""
        out = [("", 0.0, ())]
        i = 0
        while i < len(shown):
            ch, k = shown[i], 1
            if ch.isalpha() or ch in "-'’":
                out = [(w + ch, lp, used) for w, lp, used in out]
            else:
                k = 2 if shown[i : i + 2] in self.undo and ch == "\\" else 1
                ways = self.undo.get(shown[i : i + k], ())
                out = [(w + true, lp + l, (*used, (shown[i : i + k], true))) for w, lp, used in out for true, l in ways]
                if len(out) > BEAM:
                    out = sorted(out, key=lambda x: -x[1])[:BEAM]
            i += k
        return out

    def candidates(self, shown: str) -> list[tuple[str, float, tuple]]:
        """(word, log P(shown | word) + log P(word), confusions) with the word as shown first; only itself if nothing else fits.

        All marks that no word has are undone, and up to LETTERS confusions of letters beside them. What is mostly marks, or longer than LONGEST, is no word.
        """
        got = self._seen.get(shown)
        if got is not None:
            return got
        if len(self._seen) > 300_000:
            self._seen.clear()
        src, n = self.source, self.source.total
        marks = sum(not (ch.isalpha() or ch in "-'’") for ch in shown)
        own = 0.0 if marks else src.count(shown)
        best: dict[str, tuple[float, float, tuple]] = {}
        if len(shown) <= LONGEST and marks < 0.6 * len(shown) and own < max(src.least, n * 2e-4):
            wave = [(w, lp, used, 0) for w, lp, used in (self._letters_only(shown) if marks else [(shown, 0.0, ())])]
            for depth in range(LETTERS + 1):
                nxt = []
                for w, lp, used, lo in wave:
                    if used and (w not in best or best[w][0] < lp):
                        c = src.count(w)
                        if c >= src.least and c > own:
                            best[w] = (lp, c, used)
                    if depth < LETTERS and not (depth and best):
                        nxt += [(w[:i] + true + w[j:], lp + l, (*used, conf), i + len(true)) for i, j, true, l, conf in self._sites(w, lo)]
                wave = nxt
        # scans of the candidates alone may have put the word into the corpus about so often; then that is no evidence of it
        scans = 3 * sum(c * math.exp(lp) for lp, c, _ in best.values()) + 3
        base = math.log((own - 1) / n) if own > scans or own >= 2 and not best else self.UNSEEN
        out = [(shown, base, ())]
        for v, (lp, c, used) in best.items():
            score = lp + math.log(c / n)
            if score > base - 12:
                out.append((v, score, used))
        self._seen[shown] = out
        return out

    def decode(self, line: list[str]) -> list[tuple[str, tuple]]:
        """The likeliest words of a line by the Viterbi algorithm over the candidates, with the confusions undone."""
        lattice = [self.candidates(w) if w else [("", 0.0, ())] for w in line]
        if all(len(x) == 1 for x in lattice):
            return [(x[0][0], x[0][2]) for x in lattice]
        src = self.source
        score = [(c[1], -1) for c in lattice[0]]
        back = [score]
        for k in range(1, len(lattice)):
            now = []
            for w, lp, _ in lattice[k]:
                best = (-1e18, 0)
                for j, (u, _, _) in enumerate(lattice[k - 1]):
                    s = back[-1][j][0] + lp
                    if (len(lattice[k]) > 1 or len(lattice[k - 1]) > 1) and u and w:
                        cu, cw = src.count(u), src.count(w)
                        if cu > 0 and cw > 0:
                            # log of P(w | u) over P(w), smoothed
                            s += math.log((src.pair(u, w) + 5 * cw / src.total) / (cu + 5) / (cw / src.total))
                    if s > best[0]:
                        best = (s, j)
                now.append(best)
            back.append(now)
        j = max(range(len(back[-1])), key=lambda x: back[-1][x][0])
        out = []
        for k in range(len(lattice) - 1, -1, -1):
            out.append((lattice[k][j][0], lattice[k][j][2]))
            j = back[k][j][1]
        return out[::-1]


def _key(s: str) -> str:
    """Letters and digits of a line of a title, with what scans confuse folded together."""
    s = unicodedata.normalize("NFKC", s).lower()
    for a, b in (("\\/", "v"), ("@", "a"), ("+", "t"), ("|", "l"), ("·", ""), ("!", "i")):
        s = s.replace(a, b)
    s = "".join(ch for ch in s if ch.isalnum())
    for a, b in (("vv", "w"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("lc", "k"), ("ü", "u"), ("e", "c"), ("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b")):
        s = s.replace(a, b)
    return s


def _same(a: str, b: str) -> bool:
    """Two folded titles agree, but for a few misread characters."""
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 0.15 * max(len(a), len(b)):
        return False
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= 0.85 and m.ratio() >= 0.85


def _is_number(s: str) -> bool:
    """The line holds nothing but a page number."""
    if not s or len(s) > 24 or "\\" in s or s[-1] in ".,;:" or s.count("(") != s.count(")"):
        return False
    m = _NUMBER.fullmatch(s)
    if not m:
        return False
    x = m.group(1)
    if any(ch.isdigit() for ch in x):
        return True
    worded = s[: m.start(1)].strip(" -–—[](){}·.|") != ""
    if _ROMAN.fullmatch(x) and "." not in s[m.end(1) :] and "," not in s:
        return True
    return set(x) <= set("lOoI|!S") and ("." not in s and "!" not in s[m.end(1) :]) and (worded or len(x) <= 3)


_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ@]")
_MORE = re.compile(r"\s[·|•–—/]\s|\S\s{3,}\S|^\W*[0-9lOI]{1,4}\W|\W[0-9lOI]{1,4}\W*$")
_PARTS = re.compile(r"\s+[·|•–—/]\s+|\s{3,}")


def _cased(shown: str, word: str) -> str:
    """``word`` with the case of what it replaces."""
    if len(shown) > 1 and shown.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if shown[:1].isupper() else word


class Page:
    """One section: its lines told apart into running text, running titles and page numbers."""

    def __init__(self, text: str, own: list[str], books: list[str]):
        self.lines = text.split("\n")
        self.kind = ["blank" if not x.strip() else "text" for x in self.lines]
        own_keys = [k for k in map(_key, own) if k]
        keys = own_keys + [k for k in map(_key, books) if k]
        at = [i for i, k in enumerate(self.kind) if k == "text"]
        for i in at:
            if _is_number(self.lines[i].strip()):
                self.kind[i] = "page_number"
        # what is worth a closer look: as long as a title and with half its capitals, or with something beside a title
        shapes = [(0.8 * len(x) - 3, 1.2 * len(x) + 3, 0.5 * len(_CAPITAL.findall(x))) for x in map(str.strip, own + books) if x]
        for i in at if keys else ():
            s = self.lines[i].strip()
            if self.kind[i] == "text":
                n, capitals = len(s), len(_CAPITAL.findall(s))
                if any(lo <= n <= hi and capitals >= c for lo, hi, c in shapes):
                    k = _key(s)
                    if any(_same(k, x) for x in keys):
                        self.kind[i] = "header"
                        continue
                if _MORE.search(s) and any(lo <= n <= hi + 60 and capitals >= c for lo, hi, c in shapes) and self._with_more(s, keys):
                    self.kind[i] = "header"
        # the section's own title, once at its start
        first = [i for i in at[:4] if self.kind[i] == "header" and any(_same(_key(self.lines[i]), x) for x in own_keys)]
        if first and not any(self.kind[j] == "text" for j in at[: at.index(first[0])]):
            exact = [i for i in first if self.lines[i].strip() in {x.strip() for x in own}]
            plain = (exact or first)[0]
            if not any(self.kind[j] == "text" for j in at[: at.index(plain)]):
                near = [j for j in at[:4] if self.kind[j] == "page_number" and abs(j - plain) <= 2]
                if exact or not near:
                    self.kind[plain] = "title"
        # a line beside page numbers that comes again and again, whatever the title is
        beside: dict[str, list[int]] = {}
        for n, i in enumerate(at):
            if self.kind[i] == "text" and any(0 <= m < len(at) and self.kind[at[m]] == "page_number" for m in (n - 1, n + 1)):
                k = _key(self.lines[i])
                if len(k) >= 8:
                    beside.setdefault(k, []).append(i)
        for same in beside.values():
            if len(same) >= 2 and not any(self.lines[i].rstrip()[-1] in ".!?,;:-¬" for i in same):
                for i in same:
                    self.kind[i] = "header"
        self.text = [i for i, k in enumerate(self.kind) if k == "text"]

    @staticmethod
    def _with_more(s: str, keys: list[str]) -> bool:
        """A title with a page number or a publisher beside it."""
        parts = [p for p in _PARTS.split(s) if p.strip()]
        for n, p in enumerate(parts):
            if len(parts) > 1 and any(_same(_key(p), x) for x in keys):
                rest = [q for m, q in enumerate(parts) if m != n]
                if all(len(q.split()) <= 6 and q.strip()[-1:] not in ",;" for q in rest):
                    return True
        bare = re.sub(r"^\W*[0-9lOI]{1,4}\W+|\W+[0-9lOI]{1,4}\W*$", "", s)
        return bare != s and any(_same(_key(bare), x) for x in keys)


class Repair:
    """Repairs sections with a channel."""

    def __init__(self, channel: Channel):
        self.channel, self.count = channel, channel.source.count
        self.least = channel.source.least
        self._plain: dict[str, bool] = {}

    def _word(self, w: str) -> str:
        """The part of a word as shown that is looked up."""
        w = w.lower()
        if not _INWARD.search(w) or len(w) < 2:
            return ""
        if w.endswith("!"):
            # an end mark that is a misread letter
            bare = w.rstrip("!")
            return bare if len(self.channel.candidates(bare)) == 1 and self._known(bare) or len(self.channel.candidates(w)) == 1 else w
        # elided words are judged by the part behind the apostrophe
        return re.split("['’]", w)[-1] if "'" in w or "’" in w else w

    def _is_plain(self, tok: str) -> bool:
        """Whether nothing but the word itself can stand behind what is shown."""
        if len(self._plain) > 500_000:
            self._plain.clear()
        w = self._word(tok.strip(_EDGE))
        got = self._plain[tok] = not w or len(self.channel.candidates(w)) == 1
        return got

    def _known(self, w: str) -> bool:
        return self.count(w) >= self.least

    def divided(self, left: str, mark: str, right: str) -> bool:
        """Whether ``left`` and ``right``, at a line end with ``mark`` between, are one word without the mark."""
        a, b = left.lower(), right.lower()
        whole, joined = self.count(a + "-" + b), self.count(a + b)
        if max(whole, joined) >= self.least:
            return joined >= whole
        if right[0].isupper() and mark == "-":
            return False
        fixed = self.channel.candidates(a + b)
        if len(fixed) > 1:
            return True
        fixed = self.channel.candidates(a + "-" + b)
        if len(fixed) > 1:
            return False
        # two frequent words make a new compound, anything else a new word
        often = max(100 * self.least, 1e-4 * self.channel.source.total)
        return mark in SOFT or not (min(self.count(a), self.count(b)) >= often)

    def run(self, text: str, own: list[str], books: list[str]) -> tuple[str, list[tuple[int, str]]]:
        """The repaired text, and (line from 1, noise) of what was found."""
        page = Page(unicodedata.normalize("NFC", text) if not text.isascii() else text, own, books)
        found = [(i + 1, k) for i, k in enumerate(page.kind) if k in ("header", "page_number")]
        # words of the running text: (line, what stands before, the word as shown, what stands behind)
        rows: list[list] = []
        for i in page.text:
            rows.append((i, page.lines[i].split()))
        joins: dict[int, tuple[str, str, str]] = {}  # by row: what stands before and behind the line end, and what joins them
        for n in range(len(rows) - 1):
            i, toks = rows[n]
            j, after = rows[n + 1]
            if not toks or not after:
                continue
            last = toks[-1]
            if last[-1] not in BREAKS or len(last) < 2 or not last[-2].isalpha() and last[-2] not in "01569@+!|·/":
                continue
            between = page.kind[i + 1 : j]
            if between and set(between) == {"blank"}:
                continue
            left = re.search(r"[^\W_]?[\w@+!|·\\/-]*$", last[:-1]).group().strip("-")
            right = re.match(r"[\w@+!|·\\/-]*", after[0]).group()
            # only marks that stand for letters inside a word belong to it
            right = re.match(r"\w(?:[@+!|·\\/-]*\w)*", right or " ")
            right = right.group() if right else ""
            if left and right and right[0].isalpha() | (right[0] in "0156@"):
                split = self.divided(left, last[-1], right)
                joins[n] = (left, right, "" if split else "-")
                if split:
                    found.append((i + 1, "hyphen"))
        out: list[tuple[int, str]] = []
        chars: set[int] = set()
        plain = self._plain
        for n, (i, toks) in enumerate(rows):
            if n not in joins and n - 1 not in joins and all(plain.get(t) or self._is_plain(t) for t in toks):
                out.append((i, " ".join(toks)))
                continue
            shown = []
            for m, tok in enumerate(toks):
                head, cut_at = "", 0
                if m == 0 and n - 1 in joins:
                    head = joins[n - 1][0] + joins[n - 1][2]
                core = tok.strip(_EDGE)
                if m == len(toks) - 1 and n in joins:
                    core = core.rstrip(BREAKS)
                    shown.append((tok, core, core + joins[n][2] + joins[n][1], len(core), 0))
                elif head:
                    shown.append((tok, core, head + core, len(head), 1))
                else:
                    shown.append((tok, core, core, -1, 0))
            line = [self._word(whole) for _, _, whole, _, _ in shown]
            best = self.channel.decode(line)
            fixed = []
            for (tok, core, whole, at, second), w, (got, used) in zip(shown, line, best):
                if used:
                    pos = next((p for p, (x, y) in enumerate(zip(w, got)) if x != y), min(len(w), len(got)))
                    here = at < 0 or (pos >= at if second else pos < at)
                    if here:
                        chars.add(i)
                fixed.append((tok, core, whole, w, got, used, at, second))
            out.append((i, self._line(fixed, n in joins)))
        found += [(i + 1, "chars") for i in sorted(chars)]
        return self._paragraphs(page, out, joins), sorted(set(found))

    @staticmethod
    def _line(fixed: list, joined: bool) -> str:
        """A line with its words put right; a divided word stands whole on the line where it began."""
        out = []
        for tok, core, whole, w, got, used, at, second in fixed:
            if second:
                tok = tok[tok.find(core) + len(core) :] if core else tok
                if tok:
                    out.append("\0" + tok)  # what stood behind the divided word
                continue
            word = whole
            if used and w:
                k = whole.lower().rfind(w)
                word = whole[:k] + _cased(whole[k : k + len(w)], got) + whole[k + len(w) :] if k >= 0 else whole
            if at >= 0:
                out.append(tok[: tok.find(core)] + word if core in tok else word)
            else:
                out.append(tok.replace(core, word, 1) if core else tok)
        return " ".join(out)

    @staticmethod
    def _paragraphs(page: Page, out: list[tuple[int, str]], joins: dict) -> str:
        paras: list[str] = []
        before = -1
        text = dict(out)
        for i, k in enumerate(page.kind):
            if k == "title":
                paras.append(page.lines[i].strip())
                before = -1
                continue
            if k != "text":
                continue
            indent = page.lines[i].lstrip("\f")[:1] in (" ", "\t")
            between = page.kind[before + 1 : i] if before >= 0 else ["title"]
            gap = before < 0 or indent or bool(between) and set(between) == {"blank"}
            line = text[i]
            if gap or not paras:
                paras.append(line.lstrip("\0"))
            elif line.startswith("\0"):
                paras[-1] += line[1:]
            else:
                paras[-1] += " " + line
            before = i
        return "\n\n".join(p.replace("\0", "").strip() for p in paras if p.strip())


def scanned_texts(sections: DataFrame, toc: DataFrame, books: DataFrame | None) -> DataFrame:
    """(section_id, raw_text, own, books): each scanned section once, with its titles and those of its books."""
    t = clean_ids(toc, "section_id").distinct() if "title" not in toc.columns else toc.where("section_id IS NOT NULL").select("section_id", "title", "book_id")
    if books is not None:
        b = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title")).where("book_id IS NOT NULL").distinct()
        t = t.join(b, "book_id", "left")
    else:
        t = t.withColumn("book_title", F.lit(None).cast("string"))
    t = t.groupBy("section_id").agg(F.collect_set("title").alias("own"), F.collect_set("book_title").alias("books"))
    wanted = scanned_ids(toc).join(t, "section_id")
    return texts(sections).join(wanted, "section_id").dropDuplicates(["section_id"])


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    n = 0

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for tok in text.lower().split():
                w = tok.strip(_EDGE)
                if len(w) > 2 and w[-1] not in BREAKS and _INWARD.search(w):
                    seen[w] += 1
        if len(seen) > 300_000:
            yield flush()
    yield flush()


def fit_channel(scans: DataFrame, source: Source) -> dict[tuple[str, str], float]:
    """Rates of the confusions a word of scanned text, by one round of expectation maximisation over its distinct words."""
    shared = scans.sparkSession.sparkContext.broadcast(source)
    schema = "c int, n long"

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, out = Channel(shared.value), Counter()
        where = {c: i for i, c in enumerate(CONFUSIONS)}
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[-1] += n
                best = max(channel.candidates(w), key=lambda x: x[1])
                for c in best[2]:
                    out[where[c]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["c", "n"])

    types = scans.select("raw_text").mapInArrow(_types, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = {r.c: r.n for r in types.mapInArrow(used, schema).groupBy("c").agg(F.sum("n").alias("n")).collect()}
    total = got.get(-1, 0) + 1e4
    prior = Channel(source).rates
    return {c: (got.get(i, 0) + 1e4 * prior[c]) / total for i, c in enumerate(CONFUSIONS)}


def repair(sections: DataFrame, toc: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(section_id, text, found): every scanned section repaired, and found as array of (line_no, noise).

    Scanned sections are those whose toc row has a bare page number as href; they count once however often they were
    delivered. Null ids and null or blank texts give no rows; missing titles only mean that no running title is known.
    Empty tables give an empty result.
    """
    spark = sections.sparkSession
    ship(spark)
    source = fit_source(sections)
    scans = cut(scanned_texts(sections, toc, books))
    rates = fit_channel(scans, source)
    shared = spark.sparkContext.broadcast((source, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repair(Channel(*shared.value))
        noise = pa.list_(pa.struct([("line_no", pa.int32()), ("noise", pa.string())]))
        for batch in batches:
            ids, raw, own, of = (batch.column(k).to_pylist() for k in range(4))
            got = [fix.run(t, o or [], b or []) for t, o, b in zip(raw, own, of)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([x[0] for x in got], pa.string()), pa.array([[{"line_no": a, "noise": b} for a, b in x[1]] for x in got], noise)], names=["section_id", "text", "found"])

    return scans.select("section_id", "raw_text", "own", "books").mapInArrow(run, "section_id string, text string, found array<struct<line_no:int,noise:string>>")
