"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's checkpoint folder; where none is set on a single machine (as in tests), under one of this session's own."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="lexarium-"))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back; it goes when the driver ends."""
    spark = df.sparkSession
    at = folder(spark, "staged")
    fs, path = file_system(spark, at)
    atexit.register(_forget, fs, path(at))
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _forget(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM has ended before: its folder goes with the session
        return


def file_system(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and a maker of its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: what follows a scan of few row groups runs on all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_text(spark: SparkSession, at: str) -> str:
    """A small file's text."""
    fs, path = file_system(spark, at)
    stream = fs.open(path(at))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, at: str, text: str) -> bool:
    """Writes a small file if there is none of that name; whether it did. It is written under another name and renamed without
    overwriting, which on a file system such as HDFS only one of several writers can do, and only with the whole text."""
    fs, path = file_system(spark, at)
    hidden = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    out = fs.create(path(hidden), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(path(hidden), path(at), no_options)
    except Exception as e:
        fs.delete(path(hidden), False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True
