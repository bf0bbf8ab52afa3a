"""Session factory and the settings every query relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that decide results, not speed: all clocks are UTC.
RESULT_CONF = {"spark.sql.session.timeZone": "UTC"}

#: Defaults for a session that this package starts itself; a cluster's own settings win.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Start or reuse a session. ``conf`` keys use dots as given, e.g. ``**{"spark.sql.shuffle.partitions": "64"}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **RESULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read more than once."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is sent to every executor.
BROADCAST_ROWS = 20_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` evaluated once: broadcast in joins if it has at most so many rows, written and joined by shuffling if more."""
    held = df.limit(rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)) if held.num_rows <= rows else written(df)


#: Arrow batches between the JVM and Python hold so many bytes of rows, where the session has not set its own limit.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application (a zip file of its sources goes along),
    and keep Arrow batches of long texts small."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidemark-src-")), "tidemark_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(path)
    sc._tidemark_shipped = True
