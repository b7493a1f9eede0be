"""Written cuts of the lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """df written once and read back. used, and what holds() named: cuts that only df reads; they are deleted once df is written.

    A cut that nobody releases is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_cut = path
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    release(df, *used)
    return out


def holds(df: DataFrame, *used: DataFrame) -> DataFrame:
    """df, which alone reads these cuts (and those that they hold)."""
    df._tessera_holds = [y for x in used for y in (x, *getattr(x, "_tessera_holds", ()))]
    return df


def release(*frames: DataFrame) -> None:
    """Delete these cuts, and the cuts that the frames hold: nothing reads them any more."""
    for df in frames:
        for x in (df, *getattr(df, "_tessera_holds", ())):
            if path := getattr(x, "_tessera_cut", None):
                at, fs = _file_system(x.sparkSession, path)
                fs.delete(at, True)
        df._tessera_holds = []
