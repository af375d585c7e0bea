"""Cutting lineage in iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names, which driver and executors share; deleted with the session.

    A session on one machine may leave the folder unset.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{root or '/tmp/checkpoints/rounds'}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)  # what is not there is not deleted
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to a folder of its own and read back: later rounds neither repeat earlier ones nor lose them with an executor."""
    path = folder(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
