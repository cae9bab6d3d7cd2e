"""Near-duplicate texts by filters under many global orders of their tokens.

The tokens of a text are its distinct runs of ``k`` characters. A hash function and a slice of its values are a global
order of the tokens in that slice, and of two texts of similarity s the first token under such an order is the same with
probability s, wherever the edits lie and however common the tokens are. Orders are taken together in small groups: a pair
is a candidate only if it shares the first token under every order of a group, for one group at least. The filters of a
group are intersected in the key of the join itself, so no list of a single common token is ever paired with itself.

With m orders in each of g groups a pair of similarity s is no candidate with probability (1 - s^m)^g. One bit of each
first token makes a signature on which candidates must agree often enough before their texts are fetched and compared
exactly. No token is left out for being common, no text is cut and no group is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from folio.functions.text import letters_and_numbers
from folio.llm.common import slices
from folio.session import ship, stored

#: Odd multipliers; with its slices each gives as many orders of the hashed tokens.
MULTIPLIERS = np.random.default_rng(20_240_607).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive characters of a text, in order and with repeats."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: hashes of runs of 1, 2, 4 ... characters, put together to k
    with np.errstate(over="ignore"):
        power, h, at = x * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x2545F4914F6CDD1D), None, 0
        size = 1
        while True:
            if k & size:
                part = power[at : at + n]
                h = part.copy() if h is None else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
                at += size
            size *= 2
            if size > k:
                break
            half = size // 2
            power = (power[:-half] ^ (power[:-half] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + power[half:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def runs(text: str, k: int) -> np.ndarray:
    """Distinct hashes of the runs of ``k`` consecutive characters of a text, sorted."""
    h = _hashes(text, k)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def firsts(h: np.ndarray, orders: int, slices_of: int) -> np.ndarray:
    """The first of the hashed tokens ``h`` under each of ``orders`` global orders; 0 where a slice holds none.

    Every multiplier gives ``slices_of`` orders, one for each slice of the values it yields; the value is the order.
    """
    with np.errstate(over="ignore"):
        if slices_of == 1:
            return (MULTIPLIERS[:orders, None] * h[None, :]).min(axis=1)
        n = orders // slices_of
        key = MULTIPLIERS[:n, None] * h[None, :]
    key.sort(axis=1)
    step = np.uint64((1 << 64) // slices_of)
    edge = step * np.arange(slices_of, dtype=np.uint64)
    out = np.zeros((n, slices_of), np.uint64)
    for j in range(n):
        at = np.searchsorted(key[j], edge)
        got = np.append(key[j], np.uint64(0))[at]
        # the first value of a later slice, or none at all, means that the slice is empty
        out[j] = np.where((got >= edge) & (got - edge < step), got, np.uint64(0))
    return out.reshape(-1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def keyed(df: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, h) and (h, t) of all texts with at least ``least`` letters and numbers, reduced to these, under a key that equal texts share."""
    t = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= least)).select(F.col(id_col).cast("string").alias("id"), letters_and_numbers(F.col(text_col)).alias("t"))
    # reduced once, with key and length beside it: the filter is applied to the stored table, and ids are read without texts
    n = F.length("t")
    one = stored(t.select("id", F.xxhash64("t", n).alias("h"), n.alias("n"), "t")).where(F.col("n") >= least)
    return one.select("id", "h"), one.select("h", "t")


def signed(one: DataFrame, k: int, groups: int, together: int, slices_of: int) -> DataFrame:
    """(h, size, keys, sig) of the texts of (h, t): the number of its tokens, one key a group of orders, one bit an order.

    A key is the hash of the first tokens under the orders of its group and the group's number; groups none of whose
    slices holds a token have none. Copies may give several equal rows.
    """
    orders = groups * together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = MULTIPLIERS[-together:]
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
        seen: set[int] = set()
        for batch in slices(batches, 500):
            hs, sizes, keys, sigs = [], [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(h)
                x = runs(t, k)
                if not len(x):
                    continue
                v = firsts(x, orders, slices_of)
                g = v.reshape(groups, together)
                with np.errstate(over="ignore"):
                    key = ((g ^ (g >> np.uint64(29))) * weigh).sum(axis=1)
                    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.arange(groups, dtype=np.uint64)
                hs.append(h)
                sizes.append(len(x))
                keys.append(key[g.any(axis=1)].view(np.int64))
                # a middle bit: the top ones are alike among first tokens
                odd = (v >> np.uint64(20)) & np.uint64(1)
                sigs.append((np.append(odd, np.zeros(-orders % 64, np.uint64)).reshape(-1, 64) * bit).sum(axis=1).view(np.int64))
            width = -(-orders // 64)
            o = pa.array(np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32))
            q = pa.array((np.arange(len(sigs) + 1) * width).astype(np.int32))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(o, flat(keys)), pa.ListArray.from_arrays(q, flat(sigs))], names=["h", "size", "keys", "sig"])

    return one.mapInArrow(run, "h bigint, size int, keys array<bigint>, sig array<bigint>")


def meet(rows: DataFrame, key: str, own: str, *more: str, most: int = 4000) -> DataFrame:
    """All pairs of rows of one ``key``, as columns with endings a and b, the lesser ``own`` first.

    ``rows`` has a column n, the number of rows of the key. A key of more than ``most`` rows is divided: every part of its
    rows meets all of them in a task of its own.
    """
    parts = F.ceil(F.col("n") / most).cast("int")
    side = lambda x: [F.col(c).alias(c + x) for c in (own, *more)]
    a = rows.select(key, F.pmod(F.xxhash64(own), parts).cast("int").alias("part"), *side("a"))
    b = rows.select(key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *side("b"))
    return a.join(b, [key, "part"]).where(F.col(own + "a") < F.col(own + "b"))


def agreement(threshold: float, orders: int, deviations: float = 5.5) -> int:
    """How many bits of two signatures of ``orders`` bits are equal at least, for texts of that similarity, but for so many deviations.

    Bits of different first tokens are equal half of the time.
    """
    p = (1 + threshold) / 2
    return math.floor(orders * p - deviations * math.sqrt(orders * p * (1 - p)))


def near_duplicates(one: DataFrame, k: int, threshold: float, groups: int = 96, together: int = 4, slices_of: int = 1) -> DataFrame:
    """(a, b, similarity): pairs of keys of (h, t) whose texts' sets of ``k``-character runs are similar enough.

    ``groups`` and ``together`` are the numbers g and m of the module's text: fewer orders together find pairs more surely,
    more of them leave fewer candidates that aren't similar. A collection a hundred times as large wants one order more a
    group, and groups enough to keep (1 - threshold^m)^g where it was. ``slices_of`` tells how many orders one hash
    function gives: 1 for short texts, and as many as leave a few tokens a slice for long ones.

    The keys are those of :func:`keyed`: equal texts share one and are compared once. Keys of a group that few texts have
    are dropped in the one shuffle that finds them, so all later steps move candidates alone. An empty table gives an empty result.
    """
    ship(one.sparkSession)
    orders = groups * together
    every = stored(signed(one, k, groups, together, slices_of))
    posts = every.select("h", F.explode("keys").alias("key")).repartition("key").distinct()
    posts = posts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    words = -(-orders // 64)
    sig = every.select("h", "size", *(F.col("sig")[j].alias(f"s{j}") for j in range(words))).dropDuplicates(["h"])
    posts = stored(posts.join(sig, "h"))
    bits = [f"s{j}" for j in range(words)]
    j = meet(posts, "key", "h", "size", *bits).where(F.least("sizea", "sizeb") >= F.lit(threshold - 1e-9) * F.greatest("sizea", "sizeb"))
    differ = sum((F.bit_count(F.col(x + "a").bitwiseXOR(F.col(x + "b"))) for x in bits[1:]), F.bit_count(F.col(bits[0] + "a").bitwiseXOR(F.col(bits[0] + "b"))))
    j = j.where(differ <= orders - agreement(threshold, orders))
    return verify(stored(j.select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()), one, k, threshold)


def verify(pairs: DataFrame, one: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of keys of (h, t) that are similar enough, each compared exactly."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    t = one.join(wanted, "h").dropDuplicates(["h"])
    both = pairs.join(t.select(F.col("h").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("h").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(h: int, t: str) -> np.ndarray:
            got = known.get(h)
            if got is None:
                if len(known) >= 1500:
                    known.clear()
                got = known[h] = runs(t, k)
            return got

        for batch in slices(batches, 500):
            out = []
            for a, b, ta, tb in zip(*(batch.column(n).to_pylist() for n in range(4))):
                # the longer text first: if the other has too few positions for the similarity, its runs aren't needed
                (x, tx), (y, ty) = ((a, ta), (b, tb)) if len(ta) >= len(tb) else ((b, tb), (a, ta))
                long = of(x, tx)
                if len(ty) - k + 1 < (threshold - 1e-9) * len(long):
                    continue
                s = similarity(long, of(y, ty))
                if s >= threshold - 1e-12:
                    out.append((a, b, s))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def groups(member: DataFrame, pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group_id, links): for each row of (id, h) the least id of its group, and the links of its text to other texts.

    Groups are the connected components over the pairs. Labels spread and jump over tables in the shared folder, so the
    number of rounds is logarithmic in the length of a chain; no component is gathered anywhere. Should ``rounds`` not
    be enough, that is an error, never a result of parts of groups.
    """
    edges = stored(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = edges.groupBy("a").agg(F.min("b").alias("g")).select(F.col("a").alias("v"), F.least("a", "g").alias("g"))
    label = stored(label)
    for _ in range(rounds):
        near = edges.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, F.col("v") == F.col("a")).select("v", "g", F.least("g", "m").alias("m"))
        jump = label.select(F.col("v").alias("m"), F.col("g").alias("gg"))
        new = stored(step.join(jump, "m").select("v", F.col("g").alias("old"), F.least("m", "gg").alias("g")))
        label = new.select("v", "g")
        if new.where("old <> g").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are not complete after {rounds} rounds")
    links = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    m = member.select("id", "h").distinct().join(label.withColumnRenamed("v", "h"), "h", "left").join(links.withColumnRenamed("a", "h"), "h", "left")
    m = m.select("id", F.coalesce("g", "h").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    return m.join(m.groupBy("g").agg(F.min("id").alias("group_id")), "g").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))


def expand(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of different ids with equal texts or with texts that are a pair, the lesser id first."""
    m = stored(member.select("id", "h").distinct())
    a, b = (m.select(F.col("id").alias(f"id_{x}"), F.col("h").alias(x)) for x in "ab")
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("id_a", "id_b")
    several = m.join(m.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h")
    within = meet(several, "h", "id").select(F.col("ida").alias("id_a"), F.col("idb").alias("id_b"))
    return across.union(within).where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


#: Section texts: runs of 12 characters, 60 % in both. At that very similarity a pair is missed with a chance of 1.6 in a
#: million (0.8704^96), at 0.65 of 10^-8; six hash functions in 64 slices each leave three tokens a slice in the shortest text.
TEXT = {"least": 200, "how": {"k": 12, "threshold": 0.6, "groups": 96, "together": 4, "slices_of": 64}}
#: Titles: runs of 3 characters, 70 % in both; missed with a chance of 1.9 in a million (0.7599^48) at that similarity.
TITLE = {"least": 20, "how": {"k": 3, "threshold": 0.7, "groups": 48, "together": 4}}


def similar(df: DataFrame, id_col: str, text_col: str, least: int, how: dict) -> tuple[DataFrame, DataFrame]:
    """(member, pairs) of a table: (id, h) of all texts long enough, and (a, b, similarity) between the keys of different texts.

    Null ids and texts, and texts too short, are left out; an id with several texts belongs to each of their keys.
    """
    member, one = keyed(df, id_col, text_col, least)
    return member, near_duplicates(one, **how)
