"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one is made and set, but only if all executors are threads of this process; on a cluster it is an error."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{SETTING} must name a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="geospan-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the folder of this application, which is deleted when the driver ends: results read from it lazily until then."""
    root = f"{shared_dir(spark)}/geospan-{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, and the rows outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
