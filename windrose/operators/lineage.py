"""Cutting lineage, so that a lost executor costs its own tasks and iterative plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset in a local session."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="windrose-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The table, checkpointed to the shared folder."""
    _ready(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one."""
    return f"{_ready(spark).rstrip('/')}/windrose/{name}-{uuid.uuid4().hex}"


#: Rows up to which a counted side of a join is hinted for broadcast, where a row is a few numbers.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table, hinted for broadcast if it has SMALL_ROWS rows at most, else against it (shuffled); it should be cut off,
    as it is counted first."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """The table, hinted against a broadcast. Spark's estimate of a table doesn't tell how many rows an explode makes, and a
    cut keeps it, so that Spark would gather on the driver what is many times as large as it takes it for."""
    return df.hint("merge")
