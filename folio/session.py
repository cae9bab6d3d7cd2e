"""Sessions, table access, shared storage and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "folio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (one-machine sessions such as tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = sc._jsc.sc().getCheckpointDir()
        named = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="folio-shared-")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later steps read it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a compressed table: for what is large and read more than once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/folio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_folio_stored"):
        sc._folio_stored = []
    return sc._folio_stored


def clear(spark: SparkSession) -> int:
    """Delete the tables that :func:`stored` has written in this session, and tell how many; results that read them can't be computed any more."""
    paths = _stored(spark)
    n = 0
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n


def ship(spark: SparkSession) -> None:
    """Let executors import this package although it is not installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="folio-ship-"), "folio.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(root, f)
                    z.write(p, os.path.join("folio", os.path.relpath(p, here)))
    sc.addPyFile(out)
    sc._folio_shipped = True
