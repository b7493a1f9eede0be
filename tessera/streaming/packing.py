"""Packing on a stream: the tokens that do not fill a block yet are the state of their shard.

Each trigger packs what has arrived behind the remainder of the trigger before, so a shard's blocks are numbered on from batch to batch. The remainder is the first row of its shard in the
batch operator (plans/prefix, operators/pack), so no task holds a shard, however much of it a trigger brings. The state (for each shard the next block's number and less than a block of tokens) is
a small table for each trigger in the checkpoint's folder. A query that is started again goes on where it stopped; a trigger that is tried again starts from the state of the one before
and overwrites its folder of blocks and its state, so that each block is there once.

Rows of one trigger are packed in their order; rows of a later trigger come after them, whatever their order says. So a stream whose files arrive in order gives the blocks of the
batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import pack
from tessera.plans.lineage import _file_system, cut, release

#: The folder of the states beneath a checkpoint.
STATES = "remainders"


def _state_before(spark: SparkSession, checkpoint: str, number: int, schema: str) -> DataFrame:
    """The state that the last trigger before this one left: a row for each shard seen so far."""
    at, fs = _file_system(spark, f"{checkpoint}/{STATES}")
    found = [int(f.getPath().getName().removeprefix("trigger=")) for f in fs.listStatus(at)] if fs.exists(at) else []
    own = max((n for n in found if n < number), default=None)
    return spark.createDataFrame([], schema) if own is None else spark.read.schema(schema).parquet(f"{checkpoint}/{STATES}/trigger={own}")


def pack_trigger(batch: DataFrame, number: int, out: str, checkpoint: str, key: str, order: str, block_size: int) -> None:
    """Packs (key, order, ids) of one trigger behind the state of the one before; writes its blocks and then its state."""
    spark, kinds = batch.sparkSession, dict(batch.dtypes)
    before = _state_before(spark, checkpoint, number, f"{key} {kinds[key]}, next_block long, rest array<int>")
    row = lambda first, place: F.struct(F.lit(first).alias("first"), place.cast(kinds[order]).alias("place"), F.monotonically_increasing_id().alias("row"))
    rest = before.select(key, row(0, F.lit(None)).alias("__at"), F.col("rest").alias("ids"))
    rows = rest.unionAll(batch.select(key, row(1, F.col(order)).alias("__at"), "ids"))
    arrived = cut(rows.withColumn("__n", F.coalesce(F.size("ids"), F.lit(0)).cast("long")), "arrived")
    parts = pack.pieces(arrived, [key], "__at", block_size, lengths="__n")
    every = cut(pack.gathered(parts, [key]), "blocks", parts, arrived)
    full = F.size("input_ids") == block_size
    same = F.col(f"e.{key}").eqNullSafe(F.col(f"s.{key}"))
    numbered = every.where(full).alias("e").join(before.alias("s"), same, "left")
    shift = F.coalesce("s.next_block", F.lit(0))
    numbered.select(f"e.{key}", (F.col("e.block_id") + shift).alias("block_id"), "e.input_ids").write.mode("overwrite").parquet(f"{out}/trigger={number}")
    new = every.groupBy(key).agg(F.count_if(full).alias("n"), F.first(F.when(~full, F.col("input_ids")), ignorenulls=True).alias("rest"))
    # every shard with a remainder is among the new ones, as its remainder is a row
    state = new.alias("e").join(before.alias("s"), same, "full").select(
        F.when(F.col("e.n").isNotNull(), F.col(f"e.{key}")).otherwise(F.col(f"s.{key}")).alias(key), (F.coalesce("e.n", F.lit(0)) + shift).cast("long").alias("next_block"), F.coalesce("e.rest", F.array().cast("array<int>")).alias("rest")
    )
    state.write.mode("overwrite").parquet(f"{checkpoint}/{STATES}/trigger={number}")
    release(every)


def pack_arriving(spark: SparkSession, docs, inbox: str, schema: str, out: str, checkpoint: str, key: str, order: str, block_size: int, files_per_trigger: int | None = 1) -> StreamingQuery:
    """Packs the Parquet files of a folder in the order of their arrival, as far as there are any, into folders of out: one for each trigger. docs: makes (key, order, ids) of what is read.

    files_per_trigger None: all files that have arrived are one trigger.
    """
    reader = spark.readStream.schema(schema)
    arriving = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(inbox)
    own = docs(arriving).select(key, order, "ids")

    def put(batch: DataFrame, number: int) -> None:
        pack_trigger(batch, number, out, checkpoint, key, order, block_size)

    return own.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def packed_blocks(spark: SparkSession, out: str) -> DataFrame:
    """All blocks that triggers have written."""
    return spark.read.option("basePath", out).parquet(out).drop("trigger")
