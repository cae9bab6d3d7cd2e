"""Streams: landing folders, states of jobs, and counts in windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from folio.session import shared_dir


def landing_stream(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder, as (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def table_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """Rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def latest(events: DataFrame, key: str, order: str, tie: str, *cols: str) -> DataFrame:
    """(key, *cols): the latest row of each key, on a stream or a table; the state kept for a key is one row."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), F.col(tie).alias("_tie"), *cols)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in cols))


def windowed(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """(start, *by, n): rows in windows of event time; a stream drops rows later than ``late`` behind the newest, a table none."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is there now, as a table in the shared folder; nothing of it passes the driver.

    Each batch writes a folder of its own, which a batch that is tried again replaces. In complete mode the last batch is
    the result, in the others all of them are.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
        last[:] = [n]

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    own = f"{at}/rows/batch={last[0]}" if mode == "complete" else f"{at}/rows"
    return spark.read.schema(stream.schema).parquet(own)
