"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover takes over whole, well-filled bins of a second parent, drops the bins of the first
that hold one of their documents, and best-fits what is displaced, after bins have swapped one or two of their documents
for a displaced one that fills them better. Documents are dealt at random into blocks of bounded
size, so that blocks are packed side by side; each block is bred on several islands, and between epochs every island
sends its best solution to the next one, through a table in the shared folder. What a block leaves in half-empty bins is
packed again together with the leavings of other blocks.
"""

from __future__ import annotations

import bisect
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folio.session import ship, stored

#: Bins are tuples that solutions share, and are never changed.
Bins = list[tuple[int, ...]]

#: Packs are a short list that the driver reads; more are an error.
MOST_PACKS = 1000
#: How many bins a child takes over at most, and how many bins are asked to swap with what is displaced.
INJECTED, ASKED = 400, 250


def _best_fit(bins: Bins, loads: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put each item, largest first, into the bin it leaves the least room in, or into a new one."""
    if not items:
        return
    least = min(size[i] for i in items)
    order = sorted((capacity - x, k) for k, x in enumerate(loads) if capacity - x >= least)
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect.bisect_left(order, (size[i], -1))
        if at < len(order):
            room, k = order.pop(at)
            bins[k] += (i,)
            loads[k] += size[i]
            if room - size[i] >= least:
                bisect.insort(order, (room - size[i], k))
        else:
            bins.append((i,))
            loads.append(size[i])
            if capacity - size[i] >= least:
                bisect.insort(order, (capacity - size[i], len(bins) - 1))


def exchange(bins: Bins, loads: list[int], loose: list[int], size: list[int], capacity: int, asked: list[int]) -> list[int]:
    """Let the ``asked`` bins swap one or two of their items for a loose one that fills them better; the items that are loose then.

    Every swap makes the loose items smaller in sum, so they fit more easily.
    """
    order = sorted((size[i], i) for i in loose)
    last = len(size)
    for k in asked:
        room = capacity - loads[k]
        if not room or not order:
            continue
        x = bins[k]
        best, pick = 0, None
        for n, i in enumerate(x):
            # the largest loose item that fits where i was, if it is larger
            at = bisect.bisect_right(order, (size[i] + room, last))
            if at and order[at - 1][0] - size[i] > best:
                best, pick = order[at - 1][0] - size[i], (at - 1, (n,))
            if best == room:
                break
            if len(x) <= 8:
                for m in range(n):
                    both = size[i] + size[x[m]]
                    at = bisect.bisect_right(order, (both + room, last))
                    if at and order[at - 1][0] - both > best:
                        best, pick = order[at - 1][0] - both, (at - 1, (m, n))
        if pick:
            at, out = pick
            _, new = order.pop(at)
            for n in out:
                bisect.insort(order, (size[x[n]], x[n]))
            bins[k] = (*(i for n, i in enumerate(x) if n not in out), new)
            loads[k] += best
    return [i for _, i in order]


def fitness(loads: list[int], capacity: int) -> float:
    """The mean square of the bins' fill: fewer bins, and unequal ones, are better."""
    return sum(x * x for x in loads) / len(loads) / capacity**2 if loads else 1.0


Solution = tuple[Bins, list[int]]


def _settled(bins: Bins, loads: list[int], loose: list[int], size: list[int], capacity: int, rng: random.Random) -> Solution:
    asked = rng.sample(range(len(bins)), min(ASKED, len(bins)))
    _best_fit(bins, loads, exchange(bins, loads, loose, size, capacity, asked), size, capacity)
    return bins, loads


def crossover(a: Solution, b: Solution, size: list[int], capacity: int, rng: random.Random) -> Solution:
    """A child of ``a`` with a random part of the well-filled bins of ``b``; what is displaced is swapped into other bins or best-fitted."""
    full = 0.98 * capacity
    good = [k for k, x in enumerate(b[1]) if x >= full] or [max(range(len(b[1])), key=b[1].__getitem__)]
    taken = rng.sample(good, min(INJECTED, max(1, len(good) // rng.randint(2, 4))))
    inside = {i for k in taken for i in b[0][k]}
    stay = [k for k, x in enumerate(a[0]) if inside.isdisjoint(x)]
    kept = set(stay)
    loose = [i for k, x in enumerate(a[0]) if k not in kept for i in x if i not in inside]
    bins = [a[0][k] for k in stay] + [b[0][k] for k in taken]
    loads = [a[1][k] for k in stay] + [b[1][k] for k in taken]
    return _settled(bins, loads, loose, size, capacity, rng)


def mutate(a: Solution, size: list[int], capacity: int, rng: random.Random) -> Solution:
    """``a`` with its emptiest bin and a few others dissolved, swapped into the rest and best-fitted again."""
    bins, loads = list(a[0]), list(a[1])
    if len(bins) < 2:
        return bins, loads
    out = {min(range(len(loads)), key=loads.__getitem__), *rng.sample(range(len(loads)), min(3, len(loads)))}
    loose: list[int] = []
    for k in sorted(out, reverse=True):
        loose += bins[k]
        bins[k], loads[k] = bins[-1], loads[-1]
        bins.pop(), loads.pop()
    return _settled(bins, loads, loose, size, capacity, rng)


def bound(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: items above a threshold need bins of their own, and what these can't hold needs others (Martello and Toth)."""
    order = sorted(size)
    total = [0]
    for x in order:
        total.append(total[-1] + x)
    best = -(-total[-1] // capacity)
    half = bisect.bisect_right(order, capacity // 2)
    for a in {0, *order[:half]}:
        big = bisect.bisect_right(order, capacity - a)  # from here on alone
        low = bisect.bisect_left(order, a)
        alone, middle = len(order) - big, big - half
        room = middle * capacity - (total[big] - total[half])
        best = max(best, alone + middle + max(0, -(-(total[half] - total[low] - room) // capacity)))
    return best


def breed(size: list[int], capacity: int, seed: int, population: int, generations: int, migrants: list[Bins]) -> Bins:
    """The best solution of an island after some generations; migrants join its first population."""
    rng = random.Random(seed)
    items = list(range(len(size)))
    pool: list[tuple[float, Solution]] = []

    def join(bins: Bins, loads: list[int]) -> None:
        pool.append((fitness(loads, capacity), (bins, loads)))

    for n in range(max(1, population - len(migrants))):
        bins: Bins = []
        loads: list[int] = []
        if n == 0 and not migrants:
            _best_fit(bins, loads, items, size, capacity)
        else:
            # a random part fills first, so that solutions differ
            some = rng.sample(items, len(items) // 3)
            rest = set(some)
            _best_fit(bins, loads, some, size, capacity)
            _best_fit(bins, loads, [i for i in items if i not in rest], size, capacity)
        join(bins, loads)
    for m in migrants:
        join(list(m), [sum(size[i] for i in b) for b in m])
    pool.sort(key=lambda x: -x[0])
    least = bound(size, capacity)
    for _ in range(generations):
        if len(pool[0][1][0]) <= least:
            break  # no solution has fewer bins
        a, b = (min(rng.sample(range(len(pool)), min(2, len(pool)))) for _ in range(2))
        child = crossover(pool[a][1], pool[b][1], size, capacity, rng) if a != b else pool[a][1]
        if a == b or rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        f = fitness(child[1], capacity)
        if f > pool[-1][0]:
            pool[-1] = (f, child)
            pool.sort(key=lambda x: -x[0])
    return pool[0][1][0]


def pack(sizes: DataFrame, packs: DataFrame, block: int = 10_000, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 110, seed: int = 7) -> DataFrame:
    """(pack_name, bin_id, doc_id, part, tokens): every document in one bin of each pack, no bin beyond its capacity.

    ``sizes`` has (doc_id, tokens), ``packs`` (pack_name, capacity_tokens). A document larger than the capacity is divided
    into full bins and a rest, ``part`` counting from 0; no other is divided. Documents without tokens take no room and
    are left out, as are null ids, sizes and capacities; capacities below 1 are errors. Equal ids count once.

    ``block`` bounds the documents that one task packs. The bins of all blocks that stay less than nine tenths full are
    dissolved and packed once more, dealt anew; their number is a small part of the whole.
    """
    spark = sizes.sparkSession
    ship(spark)
    d = sizes.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    p = packs.where("pack_name IS NOT NULL AND capacity_tokens IS NOT NULL").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct()
    p = p.withColumn("capacity", F.when(F.col("capacity") < 1, F.raise_error(F.lit("a capacity must be positive")).cast("int")).otherwise(F.col("capacity")))
    few = [(r.pack_name, int(r.capacity)) for r in p.limit(MOST_PACKS + 1).collect()]
    if len(few) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    each = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in few)) if few else F.array().cast("array<struct<pack_name:string,capacity:int>>")
    part = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int")))
    items = d.select("doc_id", "tokens", F.explode(each).alias("p")).select("doc_id", "tokens", "p.*").select("pack_name", "capacity", "doc_id", "tokens", part.alias("part"))
    items = items.select("pack_name", "capacity", "doc_id", "part", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).alias("tokens"))
    full = items.where("tokens = capacity")
    full = full.select("pack_name", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("bin_id"), "doc_id", "part", "tokens")
    first = _bred(items.where("tokens < capacity"), block, islands, epochs, population, generations, seed, "a")
    loads = first.groupBy("pack_name", "bin_id", "capacity").agg(F.sum("tokens").alias("load"))
    slack = loads.where(F.col("load") < 0.9 * F.col("capacity")).select("pack_name", "bin_id")
    kept = first.join(slack, ["pack_name", "bin_id"], "left_anti").select("pack_name", "bin_id", "doc_id", "part", "tokens")
    loose = first.join(slack, ["pack_name", "bin_id"], "left_semi").select("pack_name", "capacity", "doc_id", "part", "tokens")
    second = _bred(loose, block, islands, 1, population, generations, seed + 1, "b").select("pack_name", "bin_id", "doc_id", "part", "tokens")
    return full.unionByName(kept).unionByName(second)


def _bred(items: DataFrame, block: int, islands: int, epochs: int, population: int, generations: int, seed: int, mark: str) -> DataFrame:
    """(pack_name, capacity, bin_id, doc_id, part, tokens): items packed block by block."""
    n = items.groupBy("pack_name").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    dealt = items.join(F.broadcast(n), "pack_name").withColumn("block", F.pmod(F.xxhash64("doc_id", "part", F.lit(seed)), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("pack_name", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("tokens", "doc_id", "part"))).alias("items"))
    blocks = stored(blocks.withColumn("items", F.struct(F.col("items.tokens").alias("tokens"), F.col("items.doc_id").alias("doc_id"), F.col("items.part").alias("part"))))
    # a number of tasks of its own: the tables are small for their work, and adaptive execution would give all blocks to one task
    tasks = max(1, min(blocks.count() * islands, 4 * items.sparkSession.sparkContext.defaultParallelism * 8))
    best = None
    for epoch in range(epochs):
        at = blocks.select("pack_name", "capacity", "block", F.col("items.tokens").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        if best is None:
            at = at.withColumn("own", F.lit(None).cast("array<int>")).withColumn("guest", F.lit(None).cast("array<int>"))
        else:
            own = best.select("pack_name", "block", "island", F.col("bins").alias("own"))
            guest = best.select("pack_name", "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("guest"))
            at = at.join(own, ["pack_name", "block", "island"]).join(guest, ["pack_name", "block", "island"])
        at = at.repartition(tasks, "pack_name", "block", "island")
        best = stored(at.mapInPandas(_island(population, generations, seed + 1000 * epoch), "pack_name string, block int, island int, bins array<int>, n_bins int, fit double"))
    choice = best.groupBy("pack_name", "block").agg(F.max_by("bins", F.struct(-F.col("n_bins"), "fit", -F.col("island"))).alias("bins"))
    out = blocks.join(choice, ["pack_name", "block"])
    out = out.select("pack_name", "capacity", "block", F.explode(F.arrays_zip(F.col("items.tokens").alias("tokens"), F.col("items.doc_id").alias("doc_id"), F.col("items.part").alias("part"), F.col("bins").alias("bin"))).alias("x"))
    return out.select("pack_name", "capacity", F.concat_ws("-", F.lit(mark), "block", "x.bin").alias("bin_id"), "x.doc_id", "x.part", "x.tokens")


def _island(population: int, generations: int, seed: int):
    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                size = [int(x) for x in r.sizes]
                migrants = [_as_bins(m) for m in (r.own, r.guest) if m is not None and len(m)]
                bins = breed(size, int(r.capacity), seed + 31 * int(r.block) + int(r.island), population, generations, migrants)
                of = np.zeros(len(size), np.int32)
                for k, b in enumerate(bins):
                    of[list(b)] = k
                out.append((r.pack_name, r.block, r.island, of, len(bins), fitness([sum(size[i] for i in b) for b in bins], int(r.capacity))))
            yield pd.DataFrame(out, columns=["pack_name", "block", "island", "bins", "n_bins", "fit"])

    return run


def _as_bins(of) -> Bins:
    bins: list[list[int]] = [[] for _ in range(int(max(of)) + 1)]
    for i, k in enumerate(of):
        bins[k].append(i)
    return list(map(tuple, bins))


def report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, bins, tokens, fill): how well the bins of each pack are filled; a pack without documents has no bins."""
    got = packed.groupBy("pack_name").agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    p = packs.where("pack_name IS NOT NULL").select("pack_name", "capacity_tokens").distinct()
    return p.join(got, "pack_name", "left").select("pack_name", F.coalesce("bins", F.lit(0)).alias("bins"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))
