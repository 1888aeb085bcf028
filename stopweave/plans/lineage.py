"""The shared folder for checkpoints, and cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that is set on the context; else, in tests, a temporary one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not held.isDefined():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="stopweave-")
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in ``checkpoint_folder``."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stopweave-{uuid.uuid4().hex}/{name}"


def put_down(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in ``checkpoint_folder`` and read again: a loop's round, with its size known to the next."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """(path, file system) as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str, name: str) -> list[int]:
    """The n of the folders name=n below ``path`` whose writing was finished, in order."""
    where, fs = folder(spark, path)
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)
