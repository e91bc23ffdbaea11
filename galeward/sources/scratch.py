"""Tables that cut a plan's lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go when a local session names no shared folder (single-machine tests only).
LOCAL_SCRATCH = "/tmp/checkpoints/galeward"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a local one if driver and executors are one
    process, and an error elsewhere: executors could not read one another's tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def session_folder(spark: SparkSession) -> str:
    """The folder of the application's tables, which goes when the application ends."""
    home = f"{scratch_root(spark)}/gw-{spark.sparkContext.applicationId}"
    fs, at = file_system(spark, home)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return home


def cut(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, so a lost
    executor costs the rerun of a read, and values made by the write (row ids, samples) stay fixed."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of cut() that nothing will read again."""
    fs, at = file_system(df.sparkSession, df._scratch)
    fs.delete(at, True)
