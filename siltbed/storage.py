"""Intermediate tables in the folder that all executors share.

Long lineages and nondeterministic columns are cut by writing a Parquet table and
reading it again, so that a lost executor never loses the only copy of a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_paths: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, an own folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = root or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by :func:`release` or when the session's JVM ends."""
    path = f"{shared_root(spark)}/siltbed/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes this process's intermediate tables; for long sessions that are done with all their results."""
    gone = 0
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read back; its rows no longer depend on ``df``'s lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
