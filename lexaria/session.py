"""Session helpers: table loading, the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's ``spark.checkpoint.dir``, or, on a local master without one, a new temporary folder."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="lexaria-")
    sc.setCheckpointDir(told)
    return told


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the shared checkpoint folder and read back: its lineage is cut as by ``checkpoint``, but it is compressed, and readers take only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, for tables that no later step reads; other frames are left alone."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it counts at most ``max_rows`` rows; otherwise as it is, so that the join shuffles.

    The check is one count over ``df``; callers pass narrow frames (two or three numeric columns), so the bound on rows bounds bytes.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores. Only an input of fewer files or row groups than cores is shuffled, by ``key``; a large one is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
