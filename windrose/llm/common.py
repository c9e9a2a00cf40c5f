"""What the operators of this subpackage share: reading tables, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between executors and Python workers, where the session leaves Spark's default of 64 MB: texts
#: are long, and a batch is held on both sides, with room to grow, for every core.
BATCH_BYTES, _BATCH_SETTING, _BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH doesn't name the repository (a local session), and bounds
    their batches by BATCH_BYTES unless the session bounds them itself."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset in a local session."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="windrose-checkpoint-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/windrose/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = hadoop(spark, path)
    return fs.exists(there)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, there = hadoop(spark, path)
        fs.delete(there, True)


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder, which cuts its lineage, and reads it back; also its path, for remove()."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def narrow(df: DataFrame) -> DataFrame:
    """At most four partitions for each core of the cluster: tables much smaller than their input need no more tasks."""
    return df.coalesce(max(16, 4 * df.sparkSession.sparkContext.defaultParallelism))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hints a broadcast if the counted rows fit BROADCAST_BYTES; else Spark shuffles, and splits skew at run time."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
