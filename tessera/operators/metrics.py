"""Run-metric series and evaluation reports: smoothing, spikes, selection, retention, rates, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def _by(run: str, step: str) -> Window:
    return Window.partitionBy(run).orderBy(step)


def affine_scan(df: DataFrame, run: str, block: int = 256) -> DataFrame:
    """df(run, i: 0, 1, 2 ... in each run, a, b) -> (run, i, s): s = a * (s before) + b, and b alone where a is 0.

    Each block of rows composes its maps into prefixes; the blocks' last prefixes are maps of their own, which the same scan carries on. So no row
    holds more than a block, whatever a run's length, and the number of levels is its logarithm to the base of block.
    """
    first = lambda a, b, carry: F.when(a == 0, b).otherwise(a * carry + b)
    rows = df.groupBy(run, F.floor(F.col("i") / block).cast("long").alias("k")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("rows"))

    def fold(done, x):
        last = F.try_element_at(done, F.lit(-1))
        a, b = F.coalesce(last["a"] * x["a"], x["a"]), F.when(last.isNull() | (x["a"] == 0), x["b"]).otherwise(x["a"] * last["b"] + x["b"])
        return F.concat(done, F.array(F.struct(x["i"].alias("i"), a.alias("a"), b.alias("b"))))

    zero = F.array().cast("array<struct<i:bigint,a:double,b:double>>")
    own = cut(rows.select(run, "k", F.aggregate("rows", zero, fold).alias("p")), "blocks")
    last = F.element_at("p", -1)
    if not own.agg(F.max("k")).first()[0]:
        return own.select(run, F.explode("p").alias("x")).select(run, "x.i", F.col("x.b").alias("s"))
    ends = affine_scan(own.select(run, F.col("k").alias("i"), last["a"].alias("a"), last["b"].alias("b")), run, block)
    carry = ends.select(F.col(run).alias("__run"), (F.col("i") + 1).alias("__k"), F.col("s").alias("__carry"))
    joined = own.join(carry, F.col(run).eqNullSafe(F.col("__run")) & (F.col("k") == F.col("__k")), "left")
    return joined.select(run, F.explode("p").alias("x"), "__carry").select(run, "x.i", first(F.col("x.a"), F.col("x.b"), F.coalesce("__carry", F.lit(0.0))).alias("s"))


def ema(df: DataFrame, run: str = "run", step: str = "step", value: str = "loss", keep: float = 0.7) -> DataFrame:
    """(run, step, value, smoothed): s = keep * s + (1 - keep) * x, from the first value on; a null gives null, and the next value begins anew."""
    w = _by(run, step)
    x, before = F.col(value).cast("double"), F.lag(value).over(w)
    fresh = before.isNull() | F.col(value).isNull()
    own = df.select(run, step, value).withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("a", F.when(fresh, 0.0).otherwise(F.lit(keep))).withColumn("b", F.when(fresh, x).otherwise(F.lit(1 - keep) * x))
    own = cut(own, "series")
    done = affine_scan(own.select(run, "i", "a", "b"), run).select(F.col(run).alias("__run"), F.col("i").alias("__i"), F.col("s").alias("smoothed"))
    return own.join(done, F.col(run).eqNullSafe(F.col("__run")) & (F.col("i") == F.col("__i"))).select(run, step, value, "smoothed")


def smoothed_minimum(smoothed: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """(run, min_loss, min_step): the first step of the lowest smoothed value."""
    return smoothed.groupBy(run).agg(F.min(F.struct("smoothed", step)).alias("m")).select(run, F.col("m.smoothed").alias("min_loss"), F.col(f"m.{step}").alias("min_step"))


def lr_ceiling(df: DataFrame, run: str = "run") -> DataFrame:
    """(run, ceiling_lr, sweet_spot_lr, min_loss, warned, low, center, high) of df(run, step, loss, grad_norm, lr).

    From the smoothed minimum on, the first step with a gradient norm over 3 times the first half's median, a loss over 1.15 times or a
    smoothed loss over 1.3 times the minimum; else the last rate, with a warning. Runs of under 10 records are left out.
    """
    ready = df.where("loss is not null and lr is not null")
    counted = ready.withColumn("rn", F.row_number().over(_by(run, "step"))).withColumn("n", F.count("*").over(Window.partitionBy(run))).where("n >= 10")
    mid = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    half = counted.where(F.col("rn") <= mid).where("grad_norm is not null").withColumn("mid", mid)
    placed = half.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("grad_norm", "step")))
    base = placed.where(F.col("place") == F.floor(F.col("mid") / 2) + 1).select(run, F.col("grad_norm").alias("base"))
    smooth = ema(counted, run).select(run, "step", "smoothed")
    low = smoothed_minimum(smooth, run)
    all_ = counted.join(smooth, [run, "step"]).join(low, run).join(base, run, "left")
    spike = (F.col("grad_norm") > F.col("base") * 3.0) | (F.col("loss") > F.col("min_loss") * 1.15) | (F.col("smoothed") > F.col("min_loss") * 1.3)
    late = F.col("step") >= F.col("min_step")
    out = all_.groupBy(run).agg(
        F.min(F.when(late & F.coalesce(spike, F.lit(False)), F.struct("step", "lr")))["lr"].alias("hit"), F.max(F.struct("step", "lr"))["lr"].alias("last"),
        F.max(F.when(F.col("step") == F.col("min_step"), F.col("lr"))).alias("sweet_spot_lr"), F.first("min_loss").alias("min_loss"),
    )
    ceiling = F.coalesce("hit", "last")
    return out.select(run, ceiling.alias("ceiling_lr"), "sweet_spot_lr", "min_loss", F.col("hit").isNull().alias("warned"), (ceiling / 10).alias("low"), (ceiling / 3).alias("center"), (ceiling / 1.5).alias("high"))


def spikes(df: DataFrame, run: str = "run", threshold: float = 1.5) -> DataFrame:
    """(run, has_spike): a loss over threshold times the lowest before it, without the first tenth; short runs have none."""
    n = F.count("*").over(Window.partitionBy(run))
    own = df.withColumn("rn", F.row_number().over(_by(run, "step"))).withColumn("n", n)
    kept = own.where((F.col("n") < 20) | (F.col("rn") > F.greatest(F.floor(F.col("n") / 10), F.lit(1))))
    before = F.min("loss").over(_by(run, "step").rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("low", before).groupBy(run).agg(F.coalesce(F.bool_or((F.col("n") >= 20) & (F.col("loss") > F.col("low") * threshold)), F.lit(False)).alias("has_spike"))


def post_warmup_spikes(df: DataFrame, warmup: int, run: str = "run", last: int | None = 5) -> DataFrame:
    """(run, has_spike): in the first third after the warm-up a loss over 1.2 times the lowest of the warm-up's last records (None: all)."""
    pre, post = df.where(F.col("step") <= warmup), df.where(F.col("step") > warmup)
    w = Window.partitionBy(run).orderBy(F.desc("step"))
    tail = pre.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last) if last else pre
    base = tail.groupBy(run).agg(F.min("loss").alias("base"))
    sized = post.withColumn("rn", F.row_number().over(_by(run, "step"))).withColumn("n", F.count("*").over(Window.partitionBy(run)))
    window = sized.where(F.col("rn") <= F.greatest(F.floor(F.col("n") / 3), F.lit(1)))
    hit = window.join(base, run).groupBy(run).agg(F.coalesce(F.bool_or(F.col("loss") > F.col("base") * 1.2), F.lit(False)).alias("has_spike"))
    return df.select(run).distinct().join(hit, run, "left").select(run, F.coalesce("has_spike", F.lit(False)).alias("has_spike"))


def grid_scores(df: DataFrame) -> Column:
    """Evaluation loss, else training loss, else 999; zero counts as missing."""
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c))
    return F.coalesce(some("eval_loss"), some("train_loss"), F.lit(999.0))


def grid_winner(df: DataFrame, margin: float | None = 0.02, group: str = "grid") -> DataFrame:
    """(grid, lr): the lowest rate of those without spikes within margin of the best; else, or without margin, the best one."""
    scored = df.withColumn("score", grid_scores(df)).withColumn("best", F.min("score").over(Window.partitionBy(group)))
    first = F.min_by("lr", F.struct("score", "pos"))
    if margin is None:
        return scored.groupBy(group).agg(first.alias("lr"))
    close = ~F.coalesce(F.col("has_spikes"), F.lit(False)) & (F.col("score") <= F.col("best") + margin)
    return scored.groupBy(group).agg(F.coalesce(F.min(F.when(close, F.col("lr"))), first).alias("lr"))


def throughput_choice(df: DataFrame, group: str = "grid", share: float = 0.95) -> DataFrame:
    """(grid, grad_accum): the last candidate (by pos) within share of the fastest; failed ones are left out."""
    valid = df.where("not failed").withColumn("best", F.max("tok_per_s").over(Window.partitionBy(group)))
    return valid.where(F.col("tok_per_s") >= F.col("best") * share).groupBy(group).agg(F.max_by("grad_accum", "pos").alias("grad_accum"))


def warmup_choice(df: DataFrame, group: str = "grid") -> DataFrame:
    """(grid, warmup_ratio): the smallest without a spike, null if all have one."""
    return df.groupBy(group).agg(F.min(F.when(~F.col("spike"), F.col("warmup_ratio"))).alias("warmup_ratio"))


def rates(df: DataFrame, tokens_per_step: int, run: str = "run", step: str = "step", seconds: str = "seconds") -> DataFrame:
    """df with tokens a second since the run's first record, and since the record before; null where no time passed."""
    w = _by(run, step)
    some = lambda dt, ds: F.when(dt > 0, ds / dt * tokens_per_step)
    first_t, last_t, last_s = F.first(seconds).over(w), F.lag(seconds).over(w), F.lag(step).over(w)
    return df.withColumn("average_rate", some(F.col(seconds) - first_t, F.col(step))).withColumn("interval_rate", some(F.col(seconds) - last_t, F.col(step) - last_s))


def as_of(df: DataFrame, run: str, step: str, value: str, name: str) -> DataFrame:
    """df with name: the value of this step, else the most recent one."""
    w = _by(run, step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def retained(df: DataFrame, best: int = 3, last: int = 3, run: str = "run", step: str = "step", loss: str = "eval_loss", milestones: list[int] = []) -> DataFrame:  # noqa: B006
    """df with keep: best by loss (missing last, ties by step), the last ones, and the milestones."""
    by_loss = F.row_number().over(Window.partitionBy(run).orderBy(F.coalesce(F.col(loss), F.lit(float("inf"))), step))
    by_step = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))
    return df.withColumn("keep", (by_loss <= best) | (by_step <= last) | F.col(step).isin(milestones or [-1]))


def best_so_far(df: DataFrame, run: str = "run", step: str = "step", value: str = "score") -> DataFrame:
    """df with the highest value up to each step and the first step that had it."""
    w = _by(run, step).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s"))).over(w)
    return df.withColumn("best", top["v"]).withColumn("best_step", -top["s"])


def eval_pivot(df: DataFrame, subsets: list[str], step: str = "step") -> DataFrame:
    """A row for each step at which the primary subset ("all") was evaluated: its loss, then the others' by name, and perplexities."""
    from tessera.functions.text import perplexity

    names = ["all", *sorted(s for s in subsets if s != "all")]
    wide = df.groupBy(step).pivot("subset", names).agg(F.first("loss")).where(F.col("all").isNotNull())
    return wide.select(step, *(F.col(n).alias(f"{n}_loss") for n in names), *(perplexity(F.col(n)).alias(f"{n}_ppl") for n in names))


def without_speed(df: DataFrame, name: str = "metric") -> DataFrame:
    """Metrics without run times and rates."""
    return df.where(~F.col(name).rlike("^eval_.*_(runtime|samples_per_second|steps_per_second)$") & ~F.col(name).rlike("^eval_(runtime|samples_per_second|steps_per_second)$"))


def swept_rate(low: float, high: float, step: Column, steps: Column) -> Column:
    """The rate at a step of a geometric sweep from low to high over so many steps."""
    return F.lit(low) * F.exp(F.log(F.lit(high / low)) * step / steps)


def tokens_per_step(block_size: Column, batch: Column, accumulate: Column) -> Column:
    return (block_size * batch * accumulate).cast("long")


def step_budget(tokens: Column, per_step: Column) -> Column:
    """Steps that see at least so many tokens."""
    return F.ceil(tokens / per_step).cast("long")


def lr_sweep(low: float, high: float, steps: int, step: str = "id") -> Column:
    """Geometric sweep from low to high."""
    return F.lit(low) * F.exp(F.log(F.lit(high / low)) * F.col(step) / steps)


# --- quantiles and means -----------------------------------------------------------------------------------------------


def linear(q: float):
    """Between the ranks around (n - 1) * q. A kind of quantile is a function of the number of values: (lower rank from 0, higher rank, the higher's share)."""
    return lambda n: (F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q)), (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q)))


def nearest(q: float):
    """Nearest rank at (n - 1) * q, halves to even."""
    rank = lambda n: F.bround((n - 1) * F.lit(q))
    return lambda n: (rank(n), rank(n), F.lit(0.0))


def exclusive(parts: int, i: int):
    """The i-th of the parts - 1 cut points at (n + 1) * i / parts; null for a single value."""

    def ranks(n):
        j = F.least(F.greatest(F.floor((n + 1) * i / parts), F.lit(1)), n - 1)
        return F.when(n > 1, j - 1), F.when(n > 1, j), ((n + 1) * i - j * parts) / parts

    return ranks


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict) -> DataFrame:
    """(keys, one column for each name of wanted: a kind of quantile of value): nulls do not count.

    Equal values collapse first, with partial sums before the shuffle, and ranks are running sums of their counts, so no group's values are gathered.
    """
    from tessera.plans.prefix import running_sum

    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_sum(seen, keys, "__v", "__n", "__from")
    total = ranked.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    if keys:
        both = ranked.alias("l").join(total.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select(*(F.col(f"l.{k}") for k in keys), "__v", "__n", "__from", "__all")
    else:
        both = ranked.crossJoin(total)  # one row
    at = lambda rank: F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__from") + F.col("__n")), F.col("__v")))
    columns = []
    for name, kind in wanted.items():
        low, high, share = kind(F.col("__all"))
        columns += [at(low).alias(f"{name}__low"), at(high).alias(f"{name}__high"), F.max(share).alias(f"{name}__share")]
    out = both.groupBy(*keys).agg(*columns)
    between = lambda name: F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * F.col(f"{name}__share")
    return out.select(*keys, *(between(name).alias(name) for name in wanted))


def nearest_of_few(value, q: float) -> Column:
    """Nearest rank of a group of bounded size, as an aggregate."""
    s = F.sort_array(F.collect_list(value))
    return F.try_element_at(s, F.greatest((F.bround((F.size(s) - 1) * F.lit(q)) + 1).cast("int"), F.lit(1)))


def guarded_mean(value) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)) / F.greatest(F.count(value), F.lit(1))


def batch_mean(df: DataFrame, batch: str, loss: str = "loss") -> DataFrame:
    """One row: the mean of the batches' mean losses, and its perplexity."""
    from tessera.functions.text import perplexity

    return df.groupBy(batch).agg(F.avg(loss).alias("l")).agg(F.avg("l").alias("loss")).withColumn("perplexity", perplexity("loss"))


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A report of few rows, numbers with four digits."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).collect()]) + "\n"
