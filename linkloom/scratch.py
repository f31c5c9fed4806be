"""Cutting lineage with tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset in local mode (tests), one of our own is set once.

    On a cluster it must be set: a folder of one machine isn't seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/linkloom-{name}-{uuid.uuid4().hex}"
    fs, hadoop_path = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def write_table(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path. It survives lost executors. ``compression`` is the session's unless named."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    return write_table(df, name, compression)[0]
