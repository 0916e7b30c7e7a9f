"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system; one without a scheme lies in Hadoop's default file system, as Spark reads it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    This is the setting spark.checkpoint.dir. Only where that is unset and
    everything runs in one process, as in local tests, a temporary folder takes
    its place; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return qualified(spark, named)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slopewise-"))
    return qualified(spark, spark.sparkContext.getCheckpointDir())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it, for workers, which have no session."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and returns them without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
