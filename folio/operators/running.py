"""Running aggregates over an order within groups, split so that a large group is in no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, keys: list[str], order: str, tie: str, width: int = 4096, backward: bool = False, **aggs: tuple[str, Column]) -> DataFrame:
    """``df`` with a running ``sum`` or ``max`` a name, over the rows of a group up to and with each row.

    ``order`` is a whole number, ``tie`` breaks ties. The order is cut into ranges of ``width``; the totals of the ranges
    before a row's are added to its running value inside its own. ``backward`` runs from the end. Null orders come first.
    """
    sign = -1 if backward else 1
    at = df.withColumn("_o", F.coalesce(F.col(order), F.lit(-1)).cast("bigint") * sign).withColumn("_b", F.floor(F.col("_o") / width))
    for name, (_, c) in aggs.items():
        at = at.withColumn(f"_v_{name}", c)
    f = {"sum": F.sum, "max": F.max}
    total = at.groupBy(*keys, "_b").agg(*(f[how](f"_v_{n}").alias(f"_t_{n}") for n, (how, _) in aggs.items()))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, "_b", *(f[how](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (how, _) in aggs.items()))
    ties = F.desc(tie) if backward else F.asc(tie)
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", ties).rowsBetween(Window.unboundedPreceding, 0)
    out = at
    for n, (how, _) in aggs.items():
        out = out.withColumn(f"_r_{n}", f[how](f"_v_{n}").over(inside))
    out = out.join(total, [*keys, "_b"])
    for n, (how, _) in aggs.items():
        r, p = F.col(f"_r_{n}"), F.col(f"_p_{n}")
        out = out.withColumn(n, F.coalesce(r, F.lit(0)) + F.coalesce(p, F.lit(0)) if how == "sum" else F.when(r.isNull(), p).when(p.isNull(), r).otherwise(F.greatest(r, p) if not _is_struct(df, n, aggs) else F.when(r > p, r).otherwise(p)))
    return out.select(*df.columns, *aggs)


def _is_struct(df: DataFrame, name: str, aggs: dict) -> bool:
    return df.select(aggs[name][1].alias("x")).schema["x"].dataType.typeName() == "struct"
