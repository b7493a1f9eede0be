"""Mergeable quantile summaries from samplesort buckets.

Each batch of a group gets a summary of its own. Pivots drawn from its values propose bucket boundaries, all its rows are counted into the buckets, and a bucket of several
values that holds too many rows is split again by pivots of its own until none is left; a bucket of one value may hold any number. A summary keeps upper edges of
buckets with their exact ranks. The whole of a group comes from its batches' summaries alone: at each edge the ranks of the summaries that have it
are exact and those of the others lie between two of their edges, so the whole knows a lowest and a highest rank of every edge.

Bounds, for n rows and S = `slots`: a kept bucket of several values holds at most 2 n / S rows, so an answer of a batch is off by at most 2 n / S ranks. Of the whole,
the ranks are known to within 2 n / S; its answer takes the middle and is off by at most 3 n / S, 0.6 % with the default. Summaries of fewer than S rows are exact.

How it scales: rows that are counted, drawn and split are keyed by bucket and piece (at most `piece` values and their pivots in one task), so no group, batch or bucket is
gathered. A window over a whole group sees edges of buckets only, a bounded number for each batch. Groups of at most `plain` rows take the
last step of every split at once: each value is a bucket. Lists of groups or buckets grow with the input, so their joins are sort-merge joins, which adaptive execution splits where a key is hot.

Defined results: rows with a null in group, batch, x or count, or a count under 1, are left out; batches are numbers from 0; ties and repeated rows count as often as they come; no rows give no
summaries; other columns are ignored, and groups may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut
from tessera.plans.prefix import offsets

#: The batch that stands for the whole of a group.
WHOLE = -1


@dataclass(frozen=True)
class Limits:
    points: int = 2000  # a summary of more edges is thinned
    slots: int = 500  # a bucket of several values is split while it holds more than n div slots rows
    piece: int = 1 << 16  # values that one task orders at once
    plain: int = 1024  # groups of at most so many rows: every value is a bucket
    rounds: int = 64  # splits of splits; never reached, as each divides a bucket by 16 or more in expectation


def _bound(n: Column, limits: Limits) -> Column:
    return F.floor(n / F.lit(limits.slots))


def _joined(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join of rows with a list that grows with the input. Its exchange serves the join alone: dealt by a hash beside the keys, which is dropped, so that nothing later takes the rows of a hot key as they lie, and adaptive execution may split them."""
    h = F.xxhash64(*on)
    return rows.withColumn("__k", h).join(few.withColumn("__k", h).hint("merge"), ["__k", *on], how).drop("__k")


def _measured(rows: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Exact counts of each bucket: rows w, values d, lowest and highest value, rows m of the highest."""
    return rows.groupBy(*keys, *cell).agg(
        F.sum("c").alias("w"), F.count("*").alias("d"), F.max("x").alias("hi"), F.max_by("c", "x").alias("m"), *([F.first("n").alias("n")] if cell else [F.sum("c").alias("n")])
    )


def buckets(values: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """(keys, x: upper edge, w: rows, m: rows of the edge itself) of the buckets of every summary. values: (keys, x, c), one row for each value."""
    found, cell, rows = [], [], values
    for turn in range(limits.rounds):
        all_ = cut(_measured(rows, keys, cell), f"buckets-{turn}")
        good = (F.col("d") == 1) | (F.col("w") <= _bound(F.col("n"), limits))
        found.append(all_.where(good).select(*keys, F.col("hi").alias("x"), "w", "m"))
        wanted = 4 * F.ceil(F.col("w") / F.greatest(_bound(F.col("n"), limits), F.lit(1))) + 16
        todo = all_.where(~good).select(*keys, *cell, "n", "w", "d", "hi", wanted.alias("wanted"), F.ceil(F.col("d") / limits.piece).alias("pieces"))
        if not todo.take(1):
            return reduce(DataFrame.unionByName, found)
        open_rows = _joined(rows.drop("n"), todo, [*keys, *cell])
        few = F.col("d") <= F.col("wanted")
        found.append(open_rows.where(few).select(*keys, "x", F.col("c").alias("w"), F.col("c").alias("m")))
        rows = cut(_counted(open_rows.where(~few), todo.where(~few), keys, cell, turn), f"split-{turn}")
        cell = ["cell"]
    raise RuntimeError("buckets are not bounded after the last round")


def _counted(rows: DataFrame, parents: DataFrame, keys: list[str], cell: list[str], turn: int) -> DataFrame:
    """Rows with the bucket that the pivots of their parent put them in: cell is the lowest pivot from x on."""
    own = [*keys, *(["parent"] if cell else [])]
    if cell:
        rows, parents = rows.withColumnRenamed("cell", "parent"), parents.withColumnRenamed("cell", "parent")
    u = F.pmod(F.xxhash64("x", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(u < F.col("wanted") * F.greatest(F.col("c") / F.col("w"), 1 / F.col("d")))  # heavy values, and values of the bucket at large
    pivots = drawn.select(*own, "x", "pieces").unionByName(parents.select(*own, F.col("hi").alias("x"), "pieces"))
    pivots = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    both = rows.select(*own, "n", "x", "c", F.pmod(F.xxhash64("x"), F.col("pieces")).alias("piece"), F.lit(None).cast("long").alias("pivot")).unionByName(
        pivots.select(*own, F.lit(0).cast("long").alias("n"), "x", F.lit(0).cast("long").alias("c"), "piece", F.col("x").alias("pivot"))
    )
    above = Window.partitionBy(*own, "piece").orderBy(F.col("x").desc())
    return both.withColumn("cell", F.min("pivot").over(above)).where(F.col("c") > 0).select(*keys, "n", "x", "c", "cell")


def _ends(slot: Column, next_slot: Column) -> Column:
    return next_slot.isNull() | (slot != next_slot)


def _chosen(upto: Column, weight: Column, n: Column, at: Column, edges: Column, following: Column, limits: Limits) -> Column:
    """Which edges a summary keeps: all if they are few, else the last of each slot of ranks, heavy buckets' own, and 64 by number, so that a summary never loses its small values."""
    slot = lambda r: F.floor(r * limits.slots / n)
    part = lambda k: F.floor(k * 64 / edges)
    return (edges <= limits.points) | _ends(slot(upto), slot(following)) | (weight * limits.slots >= n) | (part(at) != part(at + 1))


def _fractions(before: Column, upto: Column, n: Column, parts: int) -> Column:
    """The i in 1..parts - 1 whose target, ceil(i n / parts), is over `before` and at most `upto`."""
    low = F.floor(before * parts / n) + 1
    high = F.least(F.floor(upto * parts / n), F.lit(parts - 1))
    none = F.array().cast("array<long>")
    return F.when(high >= low, F.sequence(low, high)).otherwise(none)


def estimates(edges: DataFrame, group: list[str], parts: int = 20, limits: Limits = Limits()) -> DataFrame:
    """(group, batch, i, n, target, points, answer, n_below, n_upto): the answers of every batch's summary and, with the batch WHOLE, of the merged ones.

    edges: (group, batch, x, w, m) of buckets(), each x of a batch once. n_below and n_upto are exact for batches; for wholes they are lowest ranks, exact if all buckets are of one value.
    Summaries of under `parts` rows have no row.
    """
    c = F.col
    one, every = Window.partitionBy(*group, "batch"), Window.partitionBy(*group)
    up, rows, rising = one.orderBy("x"), every.orderBy("x", "batch"), every.orderBy("x")
    e = edges.repartition(*group).withColumns({"upto": F.sum("w").over(up), "at": F.row_number().over(up), "following": F.lead("w").over(up), "n": F.sum("w").over(one), "edges": F.count("*").over(one)})
    e = e.where(_chosen(c("upto"), c("w"), c("n"), c("at"), c("edges"), c("upto") + c("following"), limits))
    # what a batch's summary holds: edges and their ranks. From here on nothing else is used
    e = e.withColumns({"before": F.lag("upto", 1, 0).over(up), "points": F.count("*").over(one)})
    e = e.withColumn("loose", c("upto") - c("before") - c("m"))  # rows of the bucket whose places below its edge are not known
    e = e.withColumns({"opens": F.lead("loose", 1, 0).over(up), "first": F.when(c("before") == 0, c("loose")).otherwise(0)})
    e = e.withColumn("last", F.when(F.lead("x").over(rows) == c("x"), 0).otherwise(1))  # of the summaries that have this edge
    weight = c("upto") - c("before")
    e = e.withColumns(
        {
            "low": F.sum(weight).over(rising), "open": F.sum("first").over(every) + F.sum(c("opens") - c("loose")).over(rising), "total": F.sum(weight).over(every),
            "same": F.sum("m").over(Window.partitionBy(*group, "x")), "number": F.sum("last").over(rising), "values": F.sum("last").over(every),
        }
    )
    e = e.withColumn("mid", c("low") + F.floor(c("open") / 2))
    e = e.withColumns({"mid_before": F.coalesce(F.max("mid").over(rising.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)), "mid_after": F.lead("mid").over(rows)})
    e = e.withColumn("kept", (c("last") == 1) & _chosen(c("mid"), c("mid") - c("mid_before"), c("total"), c("number"), c("values"), c("mid_after"), limits))
    e = e.withColumns({"kept_before": F.coalesce(F.max(F.when(c("kept"), c("mid"))).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "whole_points": F.sum(c("kept").cast("long")).over(every)})

    def answered(on: Column, of: Column, before: Column, to: Column, n: Column, points: Column, below: Column, upto: Column) -> Column:
        fields = lambda k: F.struct(of.cast("int").alias("batch"), k.cast("int").alias("i"), n.alias("n"), points.alias("points"), below.alias("n_below"), upto.alias("n_upto"))
        return F.transform(F.when(on & (n >= parts), _fractions(before, to, n, parts)).otherwise(F.array().cast("array<long>")), fields)

    own = answered(F.lit(True), c("batch"), c("before"), c("upto"), c("n"), c("points"), c("upto") - c("m"), c("upto"))
    whole = answered(c("kept"), F.lit(WHOLE), c("kept_before"), c("mid"), c("total"), c("whole_points"), c("low") - c("same"), c("low"))
    out = e.select(*group, c("x").alias("answer"), F.explode(F.concat(own, whole)).alias("r"))
    return out.select(*group, "r.batch", "r.i", "r.n", F.ceil(c("r.i") * c("r.n") / parts).alias("target"), "r.points", "answer", "r.n_below", "r.n_upto")


def ranked(values: DataFrame, group: list[str]) -> DataFrame:
    """(group, batch, x, c, below) for each value of each batch and of the whole: exact ranks over Spark's range partitions."""
    whole = values.groupBy(*group, "x").agg(F.sum("c").alias("c")).select(*group, F.lit(WHOLE).alias("batch"), "x", "c")
    return offsets(values.select(*group, "batch", "x", "c").unionByName(whole), [*group, "batch"], "x", "c", "below", stay=("c",))


def summarise(rows: DataFrame, group: list[str], batch: str = "batch", parts: int = 20, limits: Limits = Limits()) -> DataFrame:
    """estimates() of rows (group, batch, x long, c: how often) held against exact ranks: with exact_x, exact n_below and n_upto, rank_error and within (1 % of n)."""
    c, own = F.col, [f"g{k}" for k in range(len(group))]
    keys = [*own, "batch"]
    named = rows.select(*(c(g).alias(o) for g, o in zip(group, own, strict=True)), c(batch).cast("int").alias("batch"), c("x").cast("long").alias("x"), c("c").cast("long").alias("c"))
    # equal values are summed before anything is dealt by group, so that no value is hot from here on
    rows = cut(named.dropna().where(c("c") > 0).groupBy(*keys, "x").agg(F.sum("c").alias("c")), "rows")
    large = cut(rows.groupBy(*own).count().where(c("count") > limits.plain).select(*own), "large-groups")
    values = cut(_joined(rows, large, own, "left_semi"), "values")

    # of a plain group every value is an edge, so its ranks are exact
    plain = _joined(rows, large, own, "left_anti").select(*keys, "x", c("c").alias("w"), c("c").alias("m"))
    exact = estimates(plain, own, parts, limits).withColumn("exact_x", c("answer"))

    found, places = cut(estimates(buckets(values, keys, limits), own, parts, limits), "answers"), ranked(values, own)
    at = _joined(places, found.select(*keys, "n").distinct(), keys).withColumn("i", F.explode(_fractions(c("below"), c("below") + c("c"), c("n"), parts)))
    held = found.drop("n_below", "n_upto").join(at.select(*keys, c("i").cast("int").alias("i"), c("x").alias("exact_x")).hint("merge"), [*keys, "i"])
    held = held.hint("merge").join(places.select(*keys, c("x").alias("answer"), c("below").alias("n_below"), (c("below") + c("c")).alias("n_upto")), [*keys, "answer"])
    error = F.greatest(F.lit(0), c("n_below") + 1 - c("target"), c("target") - c("n_upto"))
    out = exact.unionByName(held).withColumn("rank_error", error)
    back = [c(o).alias(g) for o, g in zip(own, group, strict=True)]
    return out.select(*back, c("batch").alias(batch), "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (1000 * c("rank_error") <= 10 * c("n")).alias("within"))
