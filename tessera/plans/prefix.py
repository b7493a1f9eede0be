"""Running sums and ranks over a whole table without a window that gathers all rows in one task.

What is summed is dealt to ranges of its order by Spark's own range partitioning (by sampled quantiles, so dense stretches and ties spread) and written once with the
number of its range; a window over the (few) range totals gives each range its base, and a window inside each range does the rest. Only
keys, order and value take part; other columns stay where they are and get their sums by a join. The result depends on the order alone, not on how rows lie in partitions.
Nulls of the order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, holds


def _ranged(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """df, written, with __range: numbers that ascend with the order."""
    n = parts or max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def offsets(df: DataFrame, keys: list[str], order: str, value: Column | str, name: str, inclusive: bool = False, parts: int | None = None, stay: tuple[str, ...] = ()) -> DataFrame:
    """(keys, order, stay, name): the sum of value over the rows of the same keys before each row (or up to it). order: unique within keys; stay: further, narrow columns; parts: number of ranges."""
    value = F.col(value) if isinstance(value, str) else value
    ranged = _ranged(df.select(*keys, order, *stay, value.alias("__value")), [*keys, order], parts)
    totals = ranged.groupBy(*keys, "__range").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inner = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.withColumn("__inner", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    joined = out.alias("l").join(base.alias("r"), _same([*keys, "__range"]))
    return holds(joined.select(*(f"l.{c}" for c in [*keys, order, *stay]), (F.col("__base") + F.col("__inner")).alias(name)), ranged)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column | str, name: str, inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys before this one (or up to it).

    df is read twice if it has further columns, so it should be a table or cheap to make. order: unique within keys; parts: number of ranges.
    """
    sums = offsets(df, keys, order, value, name, inclusive, parts)
    joined = df.alias("l").join(sums.alias("r"), _same([*keys, order]))
    return holds(joined.select(*(f"l.{c}" for c in df.columns), f"r.{name}"), sums)


def global_rank(df: DataFrame, order: str, ties: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with name: the row's place (from 0) in the order of a column and the columns that break ties."""
    ranged = _ranged(df, [order, *ties], parts)
    totals = ranged.groupBy("__range").agg(F.count("*").alias("__total"))
    base = totals.withColumn("__base", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties)) - 1
    out = ranged.withColumn("__inner", inner).join(F.broadcast(base), "__range").select(*df.columns, (F.col("__base") + F.col("__inner")).cast("long").alias(name))  # a row for each range
    return holds(out, ranged)
