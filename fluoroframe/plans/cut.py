"""Lineage cuts through written tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A session without the setting gets a temporary folder, but only in local
    mode: on a cluster a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cut-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Iterative operators call this once per round: the plan stays short, a lost
    executor only repeats the current round, and the file sizes give the
    optimizer true statistics for its join choice.  ``done`` are earlier cuts that
    only ``df`` still needed; their files are deleted after the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later plan reads."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
