"""Mixing sources to target shares by a splitting tree.

The sizes decide exactly how many documents of each source enter the mixture, whole repetitions first and a random part
of the documents once more. Quotas, in blocks of documents, are then divided among the output shards down a binary tree:
at each node the left half receives a multivariate hypergeometric draw of the node's blocks, so the shards partition the
quotas exactly and each is a random sample of the mixture. Blocks of a source are the slices of a random permutation of
its copies, disjoint by construction; each shard is shuffled locally at last.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from folio.session import ship, stored


#: Copies a shard holds if their number isn't given, and the most quotas (shards times sources) that the driver divides.
SHARD_ROWS, MOST_QUOTAS = 50_000, 20_000_000
#: Targets are a list that the driver reads; more sources are an error.
MOST_SOURCES = 100_000


def source_key(c):
    """A source's name without case, white space at its ends and differences of hyphen and underscore; blank is null."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")), r"[\s\-]+", "_")
    return F.when(s != "", s)


def total_size(held: dict[str, int], share: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest size at which every listed source that holds anything reaches its share within its repeats."""
    can = [held[s] * repeats[s] / share[s] for s in share if share[s] > 0 and held.get(s, 0) > 0 and repeats[s] > 0]
    return min(can, default=0.0)


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] as a matrix [shard, source] of whole numbers whose columns add up to the quotas.

    A node holds the blocks of its shards; the left child gets as many blocks as belong to its part of the shards, drawn
    without replacement from the node's blocks.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum())
        take = n * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if n else q
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def mix(sizes: DataFrame, targets: DataFrame, shards: int | None = None, block: int = 8, seed: int = 11, total: float | None = None) -> DataFrame:
    """(shard, position, doc_id, copy, source, tokens): one mixture that meets the target shares.

    ``sizes`` has (doc_id, source, tokens), ``targets`` (source, target_share, max_repeats). Names of sources are folded
    by :func:`source_key`; documents of sources that are not listed, and those without id, source or tokens, take no part;
    equal ids count once. A document is used at most ``max_repeats`` times in all: the copies of a source are whole
    rounds of all its documents, and one more round of as many, in random order, as the share still needs. ``total`` is
    the size of the mixture in tokens, by default the largest at which every source that holds anything meets its share;
    a source without documents has none, and the shares of the others keep their proportions. A source that cannot give
    what a larger ``total`` asks for gives all it may. No targets or no documents give an empty mixture.

    ``shards`` is their number, by default 16 or as many as hold 50,000 copies each. Only the targets, one row a source, and the sources' sizes reach the driver. A source's documents are ordered by the
    windows of salted parts, so a source with a third of all rows is in no single task.
    """
    spark = sizes.sparkSession
    ship(spark)
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = {r.source: (float(r.share), int(r.repeats)) for r in t.limit(MOST_SOURCES + 1).collect()}
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    listed = spark.createDataFrame([(s,) for s in rows], "source string")
    d = sizes.where("doc_id IS NOT NULL AND tokens > 0").select("doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    # the list is of checked length by now
    d = stored(d.join(F.broadcast(listed), "source").dropDuplicates(["doc_id"]))
    held = {r.source: (r.tokens, r.docs) for r in d.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    live = sorted(s for s in rows if s in held)
    whole = sum(rows[s][0] for s in live) or 1.0
    share = {s: rows[s][0] / whole for s in live}
    size = total if total is not None else total_size({s: held[s][0] for s in live}, share, {s: rows[s][1] for s in live})
    plan = [(s, min(size * share[s], held[s][0] * rows[s][1]) // held[s][0], 0) for s in live]
    plan = [(s, int(r), int(round(min(size * share[s], held[s][0] * rows[s][1]) - r * held[s][0]))) for s, r, _ in plan]
    schema = "source string, rounds int, rest bigint"
    # parts of a source: salted, so that a large source is ordered in many windows
    parts = {s: max(1, math.ceil(held[s][1] / 20_000)) for s in live}
    wide = spark.createDataFrame([(*x, parts[x[0]]) for x in plan], schema + ", parts int")
    at = d.join(F.broadcast(wide), "source").withColumn("r", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("parts")).cast("int"))
    by_part = at.groupBy("source", "part").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("source", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("source", "part").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = at.join(by_part, ["source", "part"]).withColumn("upto", F.col("t0") + F.sum("tokens").over(inside)).withColumn("nth", F.col("k0") + F.row_number().over(Window.partitionBy("source", "part").orderBy("r", "doc_id")) - 1)
    # the last document that is partly inside the rest enters if more than half of it is
    more = (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    at = stored(at.withColumn("copies", F.col("rounds") + more.cast("int")).where("copies > 0").select("source", "doc_id", "tokens", "nth", "copies", "parts", "part"))
    used = {(r.source): int(r.n) for r in at.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    names = sorted(used)
    # shards grow with the mixture, so that none is more than one task can order; their table of quotas stays bounded
    if shards is None:
        shards = max(16, math.ceil(sum(used.values()) / SHARD_ROWS))
    if shards * max(len(names), 1) > MOST_QUOTAS:
        raise ValueError(f"more than {MOST_QUOTAS} quotas of {len(names)} sources in {shards} shards")
    blocks = np.array([math.ceil(used[s] / block) for s in names], np.int64)
    tree = split_tree(blocks, shards, np.random.default_rng(seed)) if names else np.zeros((shards, 0), np.int64)
    # blocks are numbered along the permutation of a source's copies; a shard owns a run of them
    ends = tree.cumsum(0)
    owner = [(names[k], n, int(ends[n, k] - tree[n, k]), int(ends[n, k])) for n in range(shards) for k in range(len(names)) if tree[n, k]]
    owners = spark.createDataFrame(owner, "source string, shard int, lo bigint, hi bigint")
    copies = at.select("source", "doc_id", "tokens", "parts", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    # a random permutation of the copies: their rank by hash, found part by part
    copies = copies.withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed + 2)))
    copies = copies.withColumn("slot", F.least(F.col("parts") - 1, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("parts")).cast("int")))
    n_slot = copies.groupBy("source", "slot").agg(F.count(F.lit(1)).alias("k"))
    prior = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    n_slot = n_slot.select("source", "slot", F.coalesce(F.sum("k").over(prior), F.lit(0)).alias("k0"))
    copies = copies.join(n_slot, ["source", "slot"]).withColumn("at", F.col("k0") + F.row_number().over(Window.partitionBy("source", "slot").orderBy("h", "doc_id", "copy")) - 1)
    copies = copies.withColumn("b", F.floor(F.col("at") / block))
    # the owner of each block, so that the join is on equal keys and a source's copies are spread by their blocks
    owners = owners.select("source", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("b"))
    dealt = copies.join(owners, ["source", "b"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", "shard", F.lit(seed + 3)), "doc_id", "copy")
    return dealt.select("shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "copy", "source", "tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_used): what each listed source contributes."""
    t = targets.where("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    use = mixture.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("used"))
    got = use.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("used").alias("most_used"))
    j = t.join(got, "source", "left")
    # one row a target: their sum needs no more than one task
    whole = F.sum("tokens").over(Window.partitionBy())
    return j.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("tokens", "documents", "most_used")))
