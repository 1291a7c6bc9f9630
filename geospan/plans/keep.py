"""Tables that a plan reads several times: written once where executors share a folder, else held in memory and on disk."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str | None:
    """This application's folder in spark.checkpoint.dir, deleted when the driver ends; None where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return None
    root = f"{where.rstrip('/')}/plans-{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return root


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once. With spark.checkpoint.dir it is a Parquet table there, which outlives executors; without, on one machine, it is persisted."""
    root = folder(df.sparkSession)
    if root is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
