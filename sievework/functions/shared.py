"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"
#: Files that a stored table has at most for each core of the cluster.
FILES_PER_CORE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_SHARED_DIR


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends; no two calls return the same."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts the lineage and computes ``df`` once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
