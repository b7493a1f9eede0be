"""Writers: packed shards with a manifest, reports, logs, corpora."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def next_shard(manifest: DataFrame | None, most: int) -> int:
    """The id of the shard to build next; incomplete or too many shards are an error."""
    rows = manifest.collect() if manifest is not None else []  # a row for each shard
    if bad := [r.shard_id for r in rows if not r.complete]:
        raise ValueError(f"incomplete shards: {bad}")
    if len(rows) >= most:
        raise ValueError(f"all {most} shards are built")
    return max((r.shard_id for r in rows), default=-1) + 1


def write_shards(blocks: DataFrame, root: str, partition: str, expected: int, block_size: int, rows_per_file: int = 50_000) -> DataFrame:
    """Writes (shard_id, block_id, input_ids, labels, attention_mask) and then, only if all went well, the manifest that makes them count.

    All shards are written in one job, a folder for each; a failed job leaves no manifest. An existing root is an error.
    """
    spark = blocks.sparkSession
    if _exists(spark, f"{root}/manifest"):
        raise ValueError(f"{root} is complete already")
    # ranges of blocks: a task writes few shards, and a shard's files are as many as its ranges
    blocks.repartitionByRange("shard_id", "block_id").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard_id").parquet(f"{root}/blocks")
    written = spark.read.parquet(f"{root}/blocks")
    n = written.groupBy(F.col("shard_id").cast("int").alias("shard_id")).agg(F.count("*").alias("blocks"))
    manifest = n.select("shard_id", "blocks", (F.col("blocks") * block_size).alias("tokens"), F.lit(partition).alias("partition"), (F.col("blocks") >= expected).alias("complete"))
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """One JSON object; of an existing one the earlier values of other keys stay."""
    old = json.loads(spark.read.text(path, wholetext=True).first()[0]) if _exists(spark, path) else {}
    new = old | metadata | {"created_at": old.get("created_at", datetime.now(UTC).isoformat())}
    spark.createDataFrame([(json.dumps(new, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_corpus(df: DataFrame, path: str, most: int | None = None, text: str = "text", order: str | None = None) -> None:
    """Texts for a tokenizer's training elsewhere, a document and a line end each."""
    out = df.orderBy(order).limit(most) if most and order else df.limit(most) if most else df
    out.select(text).write.mode("overwrite").text(path)


def comparison_table(df: DataFrame, tasks: list[str]) -> DataFrame:
    """A row for each checkpoint, a column for each task, numbers with four digits."""
    from tessera.functions.text import four_digits

    wide = df.groupBy("checkpoint", "training_eval_loss").pivot("task", tasks).agg(F.first("value"))
    return wide.select("checkpoint", four_digits("training_eval_loss").alias("training_eval_loss"), *(four_digits(t).alias(t) for t in tasks))


def drop_incomplete(spark: SparkSession, root: str) -> list[int]:
    """Removes the folders of incomplete shards and their lines of the manifest; returns their ids."""
    rows = spark.read.parquet(f"{root}/manifest").collect()  # a row for each shard
    bad = [r.shard_id for r in rows if not r.complete]
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in bad:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/blocks/shard_id={i}"), True)
    if bad:
        good = spark.createDataFrame([r for r in rows if r.complete], spark.read.parquet(f"{root}/manifest").schema)
        good.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return bad


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, for provenance."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
