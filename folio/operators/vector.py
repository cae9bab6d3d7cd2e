"""Vectors: embedding in batches, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from folio.config import Settings
from folio.session import ship


def squared_distance(v: Column, query: list[float] | Column) -> Column:
    """The squared Euclidean distance of two vectors, in double precision."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)


def of_width(vectors: DataFrame, col: str, width: int = Settings.vector_width) -> DataFrame:
    """``vectors``, with an error for a vector that is null or of another width."""
    bad = F.col(col).isNull() | (F.size(col) != width)
    return vectors.withColumn(col, F.when(bad, F.raise_error(F.lit(f"a vector isn't of width {width}")).cast(vectors.schema[col].dataType)).otherwise(F.col(col)))


def search(vectors: DataFrame, query: list[float], where: Column | None = None, k: int = 5, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` nearest rows among those that meet ``where``, nearest first, ties by id; null vectors are left out.

    The condition is applied before any distance is computed and reaches the scan.
    """
    v = vectors.where(where) if where is not None else vectors
    return v.where(F.col(col).isNotNull()).select(id_col, squared_distance(F.col(col), query).alias("distance")).orderBy("distance", id_col).limit(k)


def _best(x: np.ndarray, xi: np.ndarray, qm: np.ndarray, qi: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, row, distance): for each query its ``k`` nearest other rows, ties by id."""
    for s in range(0, len(qi), 256):
        d = ((qm[s : s + 256, None, :] - x[None, :, :]) ** 2).sum(-1) if len(x) * 256 * x.shape[1] <= 3e7 else np.stack([((x - y) ** 2).sum(1) for y in qm[s : s + 256]])
        near = np.argpartition(d, min(k + 1, d.shape[1] - 1), axis=1)[:, : k + 2] if d.shape[1] > k + 2 else np.tile(np.arange(d.shape[1]), (len(d), 1))
        edge = np.take_along_axis(d, near, 1).max(1)
        for n in range(len(d)):
            # all rows at the edge are kept, so that ties are broken by id
            at = np.nonzero(d[n] <= edge[n])[0]
            yield from sorted(((qi[s + n], xi[j], d[n, j]) for j in at if xi[j] != qi[s + n]), key=lambda r: (r[2], r[1]))[:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", col: str = "embedding", block: int = 4096, rows_a_block: int = 50_000) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest other rows of each query, exactly, ties by id.

    Up to ``block`` queries are sent to the executors, which is checked; the rows are then read once, each partition keeps its
    own ``k`` best, and these are ranked. More queries never pass the driver: rows and queries are dealt into blocks of
    bounded size, and each block of rows meets each block of queries in a group of its own. Null vectors and ids are
    left out; all vectors must have one width.
    """
    q = queries.where(F.col(col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, col)
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, distance double"
    matrix = lambda s: np.stack(s.to_list()).astype(np.float64)

    few = q.limit(block + 1).collect()
    if len(few) <= block:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in few], dtype=object), np.array([r[1] for r in few], dtype=np.float64)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qi, qm = shared.value
            best: dict = {}
            for pdf in frames:
                if len(pdf) and len(qi):
                    for q, i, d in _best(matrix(pdf[col]), pdf[id_col].to_numpy(), qm, qi, k):
                        best.setdefault(q, []).append((d, i))
                    for q, x in best.items():
                        if len(x) > k:
                            best[q] = sorted(x)[:k]
            yield pd.DataFrame([(q, i, d) for q, x in best.items() for d, i in x], columns=["query_id", "id", "distance"])

        out = rows.mapInPandas(run, schema)
    else:
        n_rows, n_q = max(1, -(-rows.count() // rows_a_block)), max(1, -(-q.count() // block))
        deal = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = rows.select(deal(n_rows).alias("r"), every(n_q).alias("q"), F.col(id_col).alias("id"), F.col(col).alias("v"))
        b = q.select(every(n_rows).alias("r"), deal(n_q).alias("q"), F.col(id_col).alias("id"), F.col(col).alias("v"))

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            got = _best(matrix(x["v"]), x["id"].to_numpy(), matrix(y["v"]), y["id"].to_numpy(), k) if len(x) and len(y) else []
            return pd.DataFrame(got, columns=["query_id", "id", "distance"])

        out = a.groupBy("r", "q").cogroup(b.groupBy("r", "q")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = Settings.embed_batch, text_col: str = "text") -> DataFrame:
    """``chunks`` with a column ``vector``: texts go to the provider in batches, on the executors, and their order is kept.

    A provider that returns another number of vectors than texts is an error. Null texts have null vectors.
    """
    ship(chunks.sparkSession)
    schema = StructType([f for f in chunks.schema if f.name != "vector"] + [StructField("vector", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[text_col].tolist()
            at = [i for i, x in enumerate(texts) if x is not None]
            vectors: list = [None] * len(texts)
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                got = provider([texts[i] for i in part])
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                for i, v in zip(part, got):
                    vectors[i] = [float(x) for x in v]
            yield pdf.drop(columns="vector", errors="ignore").assign(vector=vectors)

    return chunks.mapInPandas(run, schema)
