"""Audits by mergeable sketches, so that a new shard needs no rescan of the old ones.

Each (shard, source) is stored with exact counts and sums and with two sketches of fixed size: a theta sketch of the fingerprints, for distinct chunks and for overlaps, and a KLL
sketch of lengths. Any set of shards is audited by merging its rows. A merged theta sketch holds the smallest hashes of all, so its estimates are the same for every order of merging;
ranks of lengths may differ within their error. (A HyperLogLog would be smaller, but its estimates after merges depend on the order.)

Stated errors with the defaults (one standard error): distinct chunks 0.8 %, overlaps 0.8 % of the union, ranks of lengths 0.7 % (k = 400). Up to 2^14 distinct chunks are counted exactly.

Sums of partial sketches are combined before the shuffle; a stored row has 8 bytes for each distinct chunk up to 130 KB, and some KB of lengths, whatever the shard's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint

ENTRIES, K = 14, 400
#: One standard error of the estimates with these sizes.
DISTINCT_ERROR, OVERLAP_ERROR, RANK_ERROR = 0.0079, 0.0079, 0.007


def stored(chunks: DataFrame, shard: str = "shard", source: str = "source", text: str = "text") -> DataFrame:
    """(shard, source, total, chars, set_sketch, length_sketch) of chunks."""
    own = chunks.select(F.col(shard).alias("shard"), F.col(source).alias("source"), fingerprint(text).alias("fp"), F.length(text).cast("long").alias("n"))
    return own.groupBy("shard", "source").agg(
        F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"),
        F.theta_sketch_agg("fp", ENTRIES).alias("set_sketch"), F.kll_sketch_agg_bigint("n", K).alias("length_sketch"),
    )


def add(store: DataFrame | None, chunks: DataFrame, **names: str) -> DataFrame:
    """The store with the rows of new shards; a shard that is stored already is replaced."""
    new = stored(chunks, **names)
    return new if store is None else store.join(new.select("shard").distinct(), "shard", "left_anti").unionByName(new)


def merged(store: DataFrame, *by: str) -> DataFrame:
    """(by, total, chars, set_sketch, length_sketch): the rows of a store put together."""
    return store.groupBy(*by).agg(
        F.sum("total").alias("total"), F.sum("chars").alias("chars"), F.theta_union_agg("set_sketch", ENTRIES).alias("set_sketch"), F.kll_merge_agg_bigint("length_sketch", K).alias("length_sketch"),
    )


def audit(store: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(source, total, distinct_n, factor, mean_chars, lengths) of all stored shards; distinct_n is an estimate, lengths are the lengths at these ranks."""
    own = merged(store, "source").withColumn("distinct_n", F.least(F.theta_sketch_estimate("set_sketch"), F.col("total")))
    at = F.array(*(F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(q)) for q in quantiles))
    return own.select("source", "total", "distinct_n", (F.col("total") / F.greatest("distinct_n", F.lit(1))).alias("factor"), (F.col("chars") / F.greatest("total", F.lit(1))).alias("mean_chars"), at.alias("lengths"))


def summary(store: DataFrame, shards: int, shard_tokens: int) -> DataFrame:
    """One row of totals: distinct chunks are estimated in each source and summed."""
    own = audit(store)
    total = own.agg(F.sum("total").alias("total"), F.sum("distinct_n").alias("distinct_n"), F.sum(F.col("mean_chars") * F.col("total")).alias("chars"))
    mean = F.col("chars") / F.greatest("total", F.lit(1))
    unique = F.col("distinct_n") * mean / 4.0
    return total.select("total", "distinct_n", (F.col("total") / F.greatest("distinct_n", F.lit(1))).alias("factor"), mean.alias("mean_chars"), unique.alias("unique_tokens"), (F.lit(float(shards * shard_tokens)) / F.greatest(unique, F.lit(1.0))).alias("epochs"))


def running(store: DataFrame) -> DataFrame:
    """(shard, total, distinct_n, factor) after each shard, from the stored sketches alone: each shard merges those up to it."""
    by = store.select("shard", "source", "total", "set_sketch")
    marks = by.select(F.col("shard").alias("upto")).distinct()
    upto = by.join(marks, F.col("shard") <= F.col("upto"))  # a row for each pair of shards
    each = upto.groupBy("upto", "source").agg(F.sum("total").alias("total"), F.theta_sketch_estimate(F.theta_union_agg("set_sketch", ENTRIES)).alias("distinct_n"))
    out = each.groupBy(F.col("upto").alias("shard")).agg(F.sum("total").alias("total"), F.sum(F.least("distinct_n", "total")).alias("distinct_n"))
    return out.withColumn("factor", F.col("total") / F.greatest("distinct_n", F.lit(1)))


def continued(state: DataFrame | None, shard_rows: DataFrame) -> DataFrame:
    """(source, total, chars, set_sketch, length_sketch) of the running totals after one more shard, from the state before it and the shard's stored rows."""
    new = merged(shard_rows, "source")
    return new if state is None else merged(state.unionByName(new), "source")


def overlaps(store: DataFrame) -> DataFrame:
    """(left, right, common, share): chunks that two shards have in common, by estimate, for each pair of shards; share is of the smaller."""
    one = merged(store, "shard").select("shard", "set_sketch", F.theta_sketch_estimate("set_sketch").alias("n"))
    left, right = (one.select(F.col("shard").alias(s), F.col("set_sketch").alias(f"{s}_set"), F.col("n").alias(f"{s}_n")) for s in ("left", "right"))
    both = left.join(right, F.col("left") < F.col("right")).withColumn("common", F.theta_sketch_estimate(F.theta_intersection("left_set", "right_set")))
    return both.select("left", "right", "common", (F.col("common") / F.greatest(F.least("left_n", "right_n"), F.lit(1))).alias("share"))
