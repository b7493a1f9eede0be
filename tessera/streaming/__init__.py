"""A Structured Streaming front end: the stateless part of a build on arriving files, and event-time metrics.

Packing depends on order and stays a batch job over what has been staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T


def staged_columns(docs: DataFrame, salt: str, holdout_rate: float, shards: int, source: str = "source", text: str = "text") -> DataFrame:
    """docs with stripped text, is_eval, shard and fp; blank texts are dropped."""
    ready = docs.withColumn(text, T.strip(text)).where(F.col(text) != "")
    name, body = F.col(source), F.col(text)
    return ready.withColumn("is_eval", T.in_holdout(name, body, salt, holdout_rate)).withColumn("shard", T.shard_bucket(name, body, salt, shards)).withColumn("fp", T.fingerprint(text))


def stage(spark: SparkSession, inbox: str, schema: str, out: str, checkpoint: str, salt: str = "", holdout_rate: float = 0.02, shards: int = 8) -> StreamingQuery:
    """Appends arriving Parquet files to a table split by is_eval and shard. A batch that is tried again overwrites itself."""
    stream = staged_columns(spark.readStream.schema(schema).parquet(inbox), salt, holdout_rate, shards)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("is_eval", "shard").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of equal texts of a source, with state bounded by the watermark."""
    return stream.withWatermark(time, delay).withColumn("fp", T.fingerprint("text")).dropDuplicatesWithinWatermark(["source", "fp"])


def tumbling(stream: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and sums by window and type; late ones count until the watermark passes."""
    got = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")
