"""Pages of repeated keywords, link lists and product tags, by rank-frequency curves.

For each page the frequencies of its words and marks are ranked. In SQL windows the curve log frequency against log rank
gets a slope and a residual, and the page a divergence from the prose of the same language and of comparable length: that of
its shares by rank, plus that of its marks (ends of sentences, commas, line ends, bars ...), which lists have in other
shares than prose. A page whose curve is extreme in none of the three is no spam. Of the others an exact check of their
lines decides whether more than half of the characters are spam: indexes, verse and contents pages have extreme curves, too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from folio.session import cut, ship

# Marks.
HIDDEN = "[­​-‏⁠﻿]"
END = ".!?…。！？।॥؟"

_HIDDEN = re.compile(HIDDEN)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][._\-]{1,3}){3,}[^\W_](?![^\W_])")
_MARK = "\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"  # combining marks belong to words
_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{_MARK}]|['’](?=[^\W_]))*")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*")
_ASCII_WORDS = bytes(x for x in range(128) if chr(x).isalnum() or x != 10 and chr(x).isspace() or x == 95)  # what is no mark
_WIDE = re.compile(r"[฀-๿぀-ヿ㐀-鿿가-힯]")
_URL = re.compile(r"(?:[a-z]+://|www\.)[^\s<>()\[\]|,]+|(?<![\w.@])(?:[\w-]+\.)+[a-z]{3,}(?:/[^\s<>()\[\]|,]*|(?![\w.]))(?<!\.txt)(?<!\.html)", re.I)
_MARKDOWN = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|<a\s[^>]*>[^<]*</a>", re.I)
_INDEX = re.compile(r"[^\d,;:]{1,60}(?:, ?\d+(?:[–-]\d+)?)+")
_CONTENTS = re.compile(r"(?:\.{3,}|…|(?:\. ){3,})\s*[\divxlc]+\s*$")
_WORK = re.compile(r"\(\d{4}[a-z]?\)")
_TAG = re.compile(r"[^\W\d_][\w.-]{0,14}\s?[:=]\s?[^\n]{0,60}")
_PAIR = re.compile(r"(?:^|[\s/|;,·])([^\W\d_][\w.-]{0,14})[:=] ?(?=\S)")
_BAR = re.compile(r"\s+(?:[|·>»/*•~→]|::|--|—)\s+|\s?[|»]\s?|\t|\s{2,}")
_OTHER = re.compile(r"[^\w\s]|\n")
_BARS = re.compile(r"[|·>»/*•~→\t—]|::|--|\s\s")
_DOTTED = re.compile(r"\w\.[a-zA-Z]{3}")
_LIST = re.compile(r"\s?[,;、，،؛]\s?")
_BULLET = re.compile(r"^(?:[-•*–·]|\d+[.)])\s+")
_ENDS = re.compile(f"[{re.escape(END)}][\"”“»«』」)）\\]'’]*$")
_INNER = re.compile(f"[{re.escape(END)}][\"”“»«』」)）\\]'’]*(?:\\s|$)|[。！？।]")
_COUNT = re.compile(r"\s\(\d+\)$")
_THAI = re.compile(r"[฀-๿]")
# Classes of marks on the curve, beside line ends, numbers, words and all other marks.
MARKS = (END, ",;，；、،؛:：", "\n", "|·>»/*•~→—–-_=#")
_CLASS_OF = {ch: k for k, chars in enumerate(MARKS) for ch in chars}


def tokens(line: str) -> list[str]:
    """Words of a line, lower-cased; pairs of characters in scripts that set no spaces."""
    if line.isascii():
        return _ASCII_TOKEN.findall(line.lower())
    found = _TOKEN.findall(line.lower())
    if not _WIDE.search(line):
        return found
    out: list[str] = []
    for t in found:
        if _WIDE.match(t) and len(t) > 2:
            out += [t[k : k + 2] for k in range(len(t) - 1)]
        else:
            out.append(t)
    return out


def _stuffed(toks: list[str]) -> bool:
    """Whether words, and pairs of words, come again more often than in prose of this length."""
    n = len(toks)
    if n < 10:
        return False
    words = 1 - len(set(toks)) / n
    if words < 0.3:  # pairs come again more rarely than words, and no limit is that low
        return False
    again = words + 1 - len(set(zip(toks, toks[1:]))) / (n - 1)
    points = ((10, 0.8), (25, 0.66), (50, 0.78), (100, 0.88), (200, 1.02), (400, 1.25), (1000, 1.55), (4000, 1.75), (100000, 1.98))
    for (x, lo), (y, hi) in zip(points, points[1:]):
        if n <= y:
            return again > lo + (hi - lo) * (n - x) / (y - x)
    return again > points[-1][1]


def _line_kind(line: str, toks: list[str]) -> tuple[str, str]:
    """What one line is, seen alone, and the key under which tags or repeated lines are counted."""
    s = line
    if 6 * (s.count(".") + s.count("_") + s.count("-")) > len(s):
        s = _SPACED.sub(lambda m: re.sub(r"[._\-]", "", m.group()), line)
    spaced = s != line
    s = s.strip()
    if (s[-1:].isdigit() or s[-1:] in "ivxlc") and s and (_INDEX.fullmatch(s) or _CONTENTS.search(s)):
        return "plain", ""
    dotted = "://" in s or "](" in s or "<a" in s or _DOTTED.search(s)
    work = "(" in s and _WORK.search(s)
    if not work and dotted and (_URL.search(s) or _MARKDOWN.search(s)):
        rest = _URL.sub(" ", _MARKDOWN.sub(" ", s))
        left = re.sub(r"[<>()\[\]]", " ", rest).strip(" -•*,;|·\t")
        inner = _INNER.search(left)
        if not inner or len(left) < 0.34 * len(s):
            return "link", ""
    if work and not _URL.search(re.sub(r"\(\d{4}[a-z]?\).*", "", s)):
        return "plain", ""
    tags = s.count("#")
    if tags and sum(len(t) for t in s.split() if t[0] == "#") >= 0.5 * len(s):
        return ("keywords", "") if tags >= 3 else ("bare", "#")
    pairs = _PAIR.findall(s) if ":" in s or "=" in s else []
    if len(pairs) >= 3 and len(set(pairs)) <= 0.75 * len(pairs) and len(_INNER.findall(s)) <= len(pairs) / 4:
        return "tags", ""
    ended = bool(_ENDS.search(s[-8:])) and not (s[-1:] == ")" and _COUNT.search(s[-12:]))
    if len(pairs) == 1 and not ended and _TAG.fullmatch(s):
        return "tag", pairs[0].lower()
    bars = [x for x in _BAR.split(s) if x and x.strip()] if _BARS.search(s) else []
    inner = lambda: len(_INNER.findall(s))
    if len(bars) >= 4 and sum(map(len, bars)) / len(bars) <= 90 and (spaced or inner() <= len(bars) / 4):
        return "captions", ""
    n = len(toks)
    rep = 1 - len(set(toks)) / n if n else 0.0
    items = [x.lower() for x in _LIST.split(s.rstrip(END)) if x] if rep > 0.3 else []
    if len(items) >= 5 and len(set(items)) <= 0.7 * len(items) and sum(len(x.split()) for x in items) <= 4 * len(items) and inner() <= len(items) / 5:
        return "keywords", ""
    if not ended and n >= 8 and rep >= 0.5 and inner() <= n / 30 and not _THAI.search(s):
        return "keywords", ""
    if _stuffed(toks):
        return "stuffed", ""
    if spaced and not inner():
        return "keywords", ""
    if ended and n < 60:
        return "sentence", ""
    if ended or s[-1:] in ",;:،؛，；：—" or s[:1] in "•":
        return "plain", ""
    if (len(s) > 80 or s.count(" ") > 1) and _THAI.search(s):
        return "plain", ""
    return "bare", s.lower()


def line_kinds(lines: list[str], toks: list[list[str]]) -> list[str]:
    """Kinds of the lines of a page, given with their words; kinds other than ``plain`` are spam."""
    got = [_line_kind(x, t) for x, t in zip(lines, toks)]
    keys = [k for kind, k in got if kind == "tag"]
    tagged = "tags" if len(keys) >= 3 and len(set(keys)) <= 0.75 * len(keys) else "plain"
    out = [{"sentence": "plain", "bare": "plain", "tag": tagged}.get(kind, kind) for kind, _ in got]
    again = Counter(key for kind, key in got if kind == "bare")
    k = 0
    while k < len(got):
        kind, j = got[k][0], k + 1
        while j < len(got) and got[j][0] == kind:
            j += 1
        if kind == "sentence" and j - k >= 2 and _stuffed([t for x in toks[k:j] for t in x]):
            out[k:j] = ["stuffed"] * (j - k)
        elif kind == "bare":
            # lone lines are headings; many together are captions, if not keywords
            for m in range(k, j):
                if j - k >= 4 or again[got[m][1]] >= 3:
                    out[m] = "captions"
        k = j
    return out


def page(text: str) -> tuple[Counter, float]:
    """Frequencies of the words and marks of a page, and the share of its characters, without line ends, on lines of spam."""
    raw = [x for x in text.split("\n") if x.strip()]
    lines = [_HIDDEN.sub("", x) for x in raw] if not text.isascii() else raw
    toks = [tokens(x) for x in lines]
    total = sum(map(len, raw))
    bad = sum(len(x) for x, k in zip(raw, line_kinds(lines, toks)) if k != "plain")
    words: Counter = Counter()
    for x in toks:
        words.update(x)
    if words:
        # marks, line ends and numbers stand on the curve too: lists are made of them
        numbers = [t for t in words if t.isdigit()]
        if numbers:
            words["0"] = sum(map(words.pop, numbers))
        words.update(text.encode().translate(None, _ASCII_WORDS).decode() if text.isascii() else _OTHER.findall(text))
    return words, bad / total if total else 0.0


def marks(words: Counter) -> list[float]:
    """Shares of the classes of marks among the words and marks of a page: those of MARKS, other marks, numbers, words."""
    n = [0] * (len(MARKS) + 3)
    for w, k in words.items():
        if len(w) == 1 and not w.isalnum():
            n[_CLASS_OF.get(w, len(MARKS))] += k
        elif w == "0":
            n[-2] += k
        else:
            n[-1] += k
    total = sum(n)
    return [x / total for x in n]


_SCRIPTS = {"kana": (0x3040, 0x3100), "han": (0x4E00, 0xA000), "th": (0xE00, 0xE80), "hi": (0x900, 0x980), "ar": (0x590, 0x780), "cy": (0x400, 0x530), "ko": (0xAC00, 0xD7B0)}
#: Of each character 0 for no letter, else 1 for Latin and others and 2 ... for the scripts above.
_CLASS = np.array([next((k for k, (lo, hi) in enumerate(_SCRIPTS.values(), 2) if lo <= o < hi), 1) if chr(o).isalpha() else 0 for o in range(0x10000)], np.uint8)


def _script(text: str) -> str:
    """The script of most letters of a text; Chinese characters are Japanese where at least a tenth of them and the kana are kana."""
    if text.isascii():
        return "la"
    n = np.bincount(_CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)], minlength=len(_SCRIPTS) + 2)[1:]
    kana, han = int(n[1]), int(n[2])
    if kana + han > max(n[0], *n[3:]):
        return "ja" if 10 * kana >= kana + han else "zh"
    n[1:3] = 0
    return ("la", *_SCRIPTS)[int(n.argmax())]


def page_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, key, lang, size, share, curve, marks) of each page with words.

    ``key`` is shared by equal texts, ``lang`` is the declared language of text in Latin script and otherwise the script's, ``size`` the logarithm of the
    number of words in steps of one half, ``curve`` the array of (frequency, number of words that have it), ``marks`` the shares of :func:`marks`.
    """
    ship(documents.sparkSession)
    curve = pa.list_(pa.struct([("f", pa.int32()), ("k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, langs, sizes, shares, curves, of_marks = [], [], [], [], [], [], []
            for i, key, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words, share = page(text)
                n = words.total()
                if n == 0:
                    continue
                script = _script(text)
                ids.append(i)
                keys.append(key)
                langs.append((lang or "").strip().lower()[:2] or "la" if script == "la" else script)
                sizes.append(int(2 * math.log(n)))
                shares.append(share)
                curves.append([{"f": f, "k": k} for f, k in Counter(words.values()).items()])
                of_marks.append(marks(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(shares, pa.float64()), pa.array(curves, curve), pa.array(of_marks, pa.list_(pa.float64()))], names=["doc_id", "key", "lang", "size", "share", "curve", "marks"])

    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "lang", "text")
    return d.mapInArrow(run, "doc_id bigint, key bigint, lang string, size int, share double, curve array<struct<f:int,k:int>>, marks array<double>")


def curves(stats: DataFrame) -> DataFrame:
    """(doc_id, key, lang, size, share, slope, residual, p0 ... p11, m0 ... m6) of each page, by windows over its rank-frequency curve.

    All words of one frequency stand on the curve as one point, at the middle of their ranks and with their number as
    weight. ``p`` are the shares of the page's words by rank, in octaves, ``m`` those of its marks.
    """
    at = stats.select("doc_id", "key", "lang", "size", "share", "marks", F.explode("curve").alias("c")).select("doc_id", "key", "lang", "size", "share", "marks", "c.f", "c.k")
    ranked = Window.partitionBy("doc_id").orderBy(F.desc("f"))
    at = at.withColumn("last", F.sum("k").over(ranked)).withColumn("rank", F.col("last") - (F.col("k") - 1) / 2)
    x, y, w = F.log("rank"), F.log("f"), F.col("k")
    fit = at.groupBy("doc_id", "key", "lang", "size", "share").agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"), F.sum(F.col("f") * w).alias("n"), F.collect_list(F.struct("last", "f", "k")).alias("points"), F.first("marks").alias("marks"))
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    slope = F.when(sxx > 1e-9, sxy / sxx).otherwise(0.0)
    fit = fit.withColumn("slope", slope).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), syy - F.col("slope") * sxy) / F.col("w")))
    # shares of words by rank: octave 0 is rank 1, octave j the ranks from 2^(j-1)+1 to 2^j
    octaves = 12

    def share(j: int):
        lo, hi = (0, 1) if j == 0 else (2 ** (j - 1), 2**j if j < octaves - 1 else 2**40)
        inside = lambda p: F.greatest(F.lit(0), F.least(p.last, F.lit(hi)) - F.greatest(p.last - p.k, F.lit(lo)))
        return F.aggregate("points", F.lit(0.0), lambda a, p: a + inside(p) * p.f) / F.col("n")

    return fit.select("doc_id", "key", "lang", "size", "share", "slope", "residual", *(share(j).alias(f"p{j}") for j in range(octaves)), *(F.col("marks")[j].alias(f"m{j}") for j in range(len(MARKS) + 3)))


def measured(documents: DataFrame, share: float = 0.5, least: int = 20) -> DataFrame:
    """(doc_id, lang, size, share, slope, residual, divergence, prose, q) of each page with words.

    ``prose`` is the number of different texts of the page's language and size of whose characters no more than ``share``
    are on lines of spam, ``q`` their quartiles of the three measures, null where there are fewer than ``least``.
    """
    c = cut(curves(page_statistics(documents)))
    p, m = [f"p{j}" for j in range(12)], [f"m{j}" for j in range(len(MARKS) + 3)]
    prose = lambda pages: pages.where(F.col("share") <= share).dropDuplicates(["lang", "size", "key"]).groupBy("lang", "size")
    mean = prose(c).agg(F.count(F.lit(1)).alias("prose"), *(F.avg(x).alias(f"mean_{x}") for x in p + m))
    c = c.join(mean, ["lang", "size"], "left").withColumn("prose", F.coalesce("prose", F.lit(0)))
    # what no prose has counts as if a small share of it had
    kl = sum((F.when(F.col(x) > 0, F.col(x) * F.log((F.col(x) + least_share) / (F.col(f"mean_{x}") + least_share))).otherwise(0.0) for names, least_share in ((p, 1e-4), (m, 1e-3)) for x in names), F.lit(0.0))
    c = cut(c.select("doc_id", "key", "lang", "size", "share", "prose", "slope", "residual", kl.alias("divergence")))
    mid = prose(c).agg(F.struct(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in MEASURES)).alias("q"))
    c = c.join(mid, ["lang", "size"], "left")
    return c.select("doc_id", "lang", "size", "share", *MEASURES, "prose", F.when(F.col("prose") >= least, F.col("q")).alias("q")).dropDuplicates(["doc_id"])


MEASURES = ("slope", "residual", "divergence")


def extreme(z: float = 3.0):
    """Whether a page of :func:`measured` is extreme: beyond ``z`` median deviations of prose in slope or residual, on either side, or in divergence, above.

    Where there is too little prose to tell, every page is.
    """
    out = F.lit(False)
    for x in MEASURES:
        q = F.col(f"q.{x}")
        off = (F.col(x) - q[1]) / F.greatest((q[2] - q[0]) / 2, F.lit(1e-6))
        out = out | ((off if x == "divergence" else F.abs(off)) > z)
    return F.coalesce(out, F.lit(True))


def spam_pages(documents: DataFrame, z: float = 3.0, share: float = 0.5, least: int = 20) -> DataFrame:
    """(doc_id, slope, residual, divergence, share) of the pages of spam.

    Slope, residual and divergence of a page are held against the median of the prose of its language and size, in units
    of the median deviation; only a page beyond ``z`` in one of them can be spam, and it is if more than ``share`` of its
    characters are on lines of spam. Prose are the different texts of whose characters no more than ``share`` are. Where
    there are fewer than ``least`` of them every page is extreme. Null ids, null and blank texts and texts without a word
    give no rows; equal texts are judged alike under each of their ids; null and odd languages form groups of their own.
    An empty table gives an empty result.
    """
    c = measured(documents, share, least)
    return c.where(extreme(z) & (F.col("share") > share)).select("doc_id", *MEASURES, "share")
