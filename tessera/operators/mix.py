"""Weighted mixing, sampling, ordering and limits.

A weighted mix of streams draws the next source in proportion to its weight. Here every row of a source gets an exponential gap from a
hash of (seed, source, position), divided by the source's weight; running sums of gaps are arrival times, and the mix is the order of
arrival. That has the distribution of independent weighted draws, weights renormalised as sources run out, and is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hash_ratio
from tessera.plans.lineage import holds
from tessera.plans.prefix import global_rank, offsets


def with_gaps(df: DataFrame, weights: dict[str, float], seed: int, source: str = "source", pos: str = "pos") -> DataFrame:
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    u = (hash_ratio(F.lit(str(seed)), F.col(source), F.col(pos).cast("string")) * F.lit(0.999999) + F.lit(5e-7)).alias("u")
    return df.where(F.col(source).isin(list(weights))).withColumn("__gap", -F.log(u) / F.element_at(weight, F.col(source)))


def mix(df: DataFrame, weights: dict[str, float], seed: int = 0, source: str = "source", pos: str = "pos") -> DataFrame:
    """df with mix_pos: the row's place in a weighted mix of its sources without replacement. pos: place in the source, unique there.

    The order is found over (source, pos) alone; the rows take their places from it by one join.
    """
    timed = offsets(with_gaps(df.select(source, pos), weights, seed, source, pos), [source], pos, "__gap", "__arrival", inclusive=True)
    ranked = global_rank(timed, "__arrival", [source, pos], "mix_pos")
    return holds(df.join(ranked.drop("__arrival"), [source, pos]).select(*df.columns, "mix_pos"), timed, ranked)


def mix_restart(df: DataFrame, weights: dict[str, float], epochs: int, seed: int = 0, source: str = "source", pos: str = "pos") -> DataFrame:
    """As mix, but an exhausted source starts again, up to epochs times; epoch tells which pass a row is from."""
    sizes = df.groupBy(source).agg(F.count("*").alias("__n"))
    again = df.join(sizes, source).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    again = again.withColumn("__pos", F.col(pos) + F.col("epoch") * F.col("__n")).drop("__n")
    return mix(again, weights, seed, source, "__pos").drop("__pos")


def mix_first_exhausted(df: DataFrame, weights: dict[str, float], seed: int = 0, source: str = "source", pos: str = "pos") -> DataFrame:
    """As mix, stopped where the first source has given its last row."""
    mixed = mix(df, weights, seed, source, pos)
    end = mixed.groupBy(source).agg(F.max("mix_pos").alias("__last")).agg(F.min("__last").alias("__end"))
    return mixed.join(F.broadcast(end), F.col("mix_pos") <= F.col("__end")).drop("__end")  # one row


def shuffle_key(seed: int, *cols: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)), 256)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A full shuffle by a hash of the key: the same for every partitioning."""
    return df.orderBy(shuffle_key(seed, *key), *key)


def split(df: DataFrame, test_size: float, seed: int, *key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash threshold; sizes are approximate."""
    r = hash_ratio(F.lit(str(seed)), *(F.col(k).cast("string") for k in key))
    return df.where(r >= test_size), df.where(r < test_size)


def first_filled_rows(df: DataFrame, n: int, seed: int, text: str, key: str) -> DataFrame:
    """The first n rows of the shuffle whose text is not blank."""
    from tessera.functions.text import strip

    return df.where(strip(text) != "").orderBy(shuffle_key(seed, key), key).limit(n)


def even_sample(df: DataFrame, sample: int, order: str) -> DataFrame:
    """Rows at int(i * n / sample) of the order; all rows if there are no more than sample."""
    ranked = global_rank(df.withColumn("__o", F.col(order).cast("double")), "__o", [order], "__rn").drop("__o")
    n = df.count()
    if sample >= n:
        return ranked.drop("__rn")
    picks = df.sparkSession.range(sample).select(F.floor(F.col("id") * F.lit(n / sample)).cast("long").alias("__rn"))
    return ranked.join(picks, "__rn").drop("__rn")


def token_budget(blocks: DataFrame, tokens: int, block_size: int, block: str = "block_id") -> DataFrame:
    """The blocks until at least so many tokens are out."""
    return blocks.where(F.col(block) < -(-tokens // block_size))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, n: int, group: str, *order) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
