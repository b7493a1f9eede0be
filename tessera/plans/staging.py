"""Staged texts as a bucketed table: what is done by source and shard needs no exchange.

The table is hashed by (source, shard_id) into buckets, each sorted, so joins with tables staged alike, duplicate counts, shard totals and windows of a source's shard
read buckets as they lie. Shards are dealt by content, so equal texts of a source are in one bucket, and buckets grow evenly with more shards: `buckets` should be a few
times the number of cores, and shards times sources many times the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

KEYS = ["source", "shard_id"]


def stage_table(df: DataFrame, table: str, path: str, buckets: int = 64, order: list[str] | None = None) -> DataFrame:
    """Writes df (source, shard_id ...) as a bucketed table at a path that all executors reach; gives the table."""
    spark = df.sparkSession
    # dealt as the buckets are hashed: each task writes the files of few buckets
    df.repartition(buckets, *KEYS).write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS, *(order or [])).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"drop table if exists {table}")


def duplicates(staged: DataFrame, text: str = "text") -> DataFrame:
    """(source, shard_id, total, distinct_n, factor) of the texts of each source's shards."""
    seen = staged.groupBy(*KEYS, T.fingerprint(text).alias("fp")).agg(F.count("*").alias("n"))
    out = seen.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_n"))
    return out.withColumn("factor", F.col("total") / F.greatest("distinct_n", F.lit(1)))


def offsets(staged: DataFrame, order: str, length) -> DataFrame:
    """staged with from: the sum of length over the rows of the same source's shard before this one."""
    from pyspark.sql import Window

    before = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return staged.withColumn("from", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def exchanges(df: DataFrame) -> int:
    """Number of exchanges in the physical plan, for tests and reports."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
