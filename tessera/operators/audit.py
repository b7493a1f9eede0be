"""Duplicate audits and verification gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import block_fingerprint, fingerprint
from tessera.plans.prefix import running_sum


def per_source(chunks: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, total, distinct_n, factor): exact duplicates within each source, partial sums before the shuffle."""
    seen = chunks.groupBy(source, fingerprint(text).alias("fp")).agg(F.count("*").alias("n"))
    out = seen.groupBy(source).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_n"))
    return out.withColumn("factor", F.col("total") / F.greatest("distinct_n", F.lit(1)))


def summary(chunks: DataFrame, shards: int, shard_tokens: int, source: str = "source", text: str = "text") -> DataFrame:
    """One row of totals; distinct chunks are counted in each source (and, beside, over all sources)."""
    seen = chunks.groupBy(source, fingerprint(text).alias("fp")).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    total = seen.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_n"), F.sum("chars").alias("chars"), F.count_distinct("fp").alias("global_distinct"))
    mean = F.col("chars") / F.greatest("total", F.lit(1))
    unique = F.col("distinct_n") * (mean / 4.0)
    return total.select(
        "total", "distinct_n", "global_distinct", (F.col("total") / F.greatest("distinct_n", F.lit(1))).alias("factor"), mean.alias("mean_chars"),
        unique.alias("unique_tokens"), (F.lit(float(shards * shard_tokens)) / F.greatest(unique, F.lit(1.0))).alias("epochs"),
    )


def running(chunks: DataFrame, shard: str = "shard", source: str = "source", text: str = "text") -> DataFrame:
    """(shard, total, distinct_n, factor) after each shard: a chunk counts as new in the first shard that has it."""
    seen = chunks.groupBy(source, fingerprint(text).alias("fp")).agg(F.min(shard).alias(shard))
    new = seen.groupBy(shard).agg(F.count("*").alias("new"))
    all_ = chunks.groupBy(shard).agg(F.count("*").alias("n"))
    w = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, 0)  # a row for each shard
    both = all_.join(new, shard, "left").select(shard, F.sum("n").over(w).alias("total"), F.sum(F.coalesce("new", F.lit(0))).over(w).alias("distinct_n"))
    return both.withColumn("factor", F.col("total") / F.greatest("distinct_n", F.lit(1)))


def across_shards(blocks: DataFrame, shard: str = "shard", ids: str | None = "input_ids", text: str | None = None, limit: float = 1.01) -> DataFrame:
    """One row: blocks, distinct ones, collisions across shards, factor and whether it passes the gate."""
    key = block_fingerprint(ids) if text is None else fingerprint(text)
    by = blocks.groupBy(key.alias("fp")).agg(F.count("*").alias("n"), F.count_distinct(shard).alias("k"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_n"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("collisions"))
    return out.withColumn("factor", F.col("total") / F.greatest("distinct_n", F.lit(1))).withColumn("passed", F.col("factor") <= limit)


def preflight(spark, checks: list[tuple[str, bool, str]]) -> DataFrame:
    """(pos, check, passed, detail) of driver-side checks."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(checks)], "pos int, check string, passed boolean, detail string")


def shard_guard(found: set[int], complete: set[int], expected: int) -> tuple[int, str]:
    """(exit code, message): 0 all there, 1 too few or none, 2 incomplete ones."""
    if found - complete:
        return 2, f"incomplete shards: {sorted(found - complete)}"
    if len(complete) < expected or not complete:
        return 1, f"{len(complete)} of {expected} shards"
    return 0, "ok"


def replay(chunks: DataFrame, taken: DataFrame, shard: str = "shard", source: str = "source", order: str = "mix_pos", text: str = "text") -> DataFrame:
    """(source, total, distinct_n, factor) of the chunks that shards have taken: of each shard the first `n` of taken(shard, n) in mix order."""
    placed = running_sum(chunks, [shard], order, F.lit(1), "__place")
    return per_source(placed.join(taken, shard).where("__place < n"), source, text)


def report(chunks: DataFrame, shards: int, shard_tokens: int, path: str, shard: str = "shard") -> None:
    """Writes the audit as one JSON object: totals, sources by size, running totals by shard."""
    one = summary(chunks, shards, shard_tokens).select(F.struct("*").alias("totals"))
    by = per_source(chunks).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), "source", "total", "distinct_n", "factor"))).alias("per_source"))
    steps = running(chunks, shard).agg(F.array_sort(F.collect_list(F.struct(shard, "total", "distinct_n", "factor"))).alias("shard_results"))
    one.crossJoin(by).crossJoin(steps).coalesce(1).write.mode("overwrite").json(path)  # three single rows
