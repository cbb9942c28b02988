"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a session on one machine has none, a temporary folder is made and set for it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this application that goes when its driver ends."""
    own = f"{shared_dir(spark)}/rasterloom-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """The table as a side of a join that deals out both sides by key.

    For tables that grow with the input: written ones are planned by the size of
    their compressed files, by which Spark would send them whole through the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back, so that its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
