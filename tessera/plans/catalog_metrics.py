"""Queries: duplicate audits, run metrics, quantiles, set operations and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit
from tessera.operators import metrics as M
from tessera.plans import sql as S
from tessera.plans.catalog_text import BUCKET, READY, SALT, SHARDS, ready, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- audits --------------------------------------------------------------------------------------------------------------

SEEN = f"seen AS (SELECT source, sha256(c) AS fp, count(*) AS n, sum(length(c)) AS chars FROM (SELECT source, unnest({S.chunks('t', 500)}) AS c FROM {READY}) GROUP BY ALL)"


def chunked(spark, d):
    return ready(spark, d).select("source", F.explode(T.text_chunks("t", 500)).alias("text"))


@query(f"WITH {SEEN} SELECT source, sum(n)::BIGINT AS total, count(*) AS distinct_n, round(sum(n)::DOUBLE / greatest(count(*), 1), 9) AS factor FROM seen GROUP BY source")
def dedup_audit(spark, d):
    return audit.per_source(chunked(spark, d)).withColumn("factor", F.round("factor", 9))


@query(f"""WITH {SEEN}, s AS (SELECT sum(n)::BIGINT AS total, count(*) AS distinct_n, count(DISTINCT fp) AS global_distinct, sum(chars)::DOUBLE AS chars FROM seen)
SELECT total, distinct_n, global_distinct, round(total::DOUBLE / distinct_n, 9) AS factor, round(chars / total, 6) AS mean_chars, round(distinct_n * (chars / total / 4.0::DOUBLE), 3) AS unique_tokens, round(1e7::DOUBLE / greatest(distinct_n * (chars / total / 4.0::DOUBLE), 1), 6) AS epochs FROM s""")
def dedup_summary(spark, d):
    out = audit.summary(chunked(spark, d), 10, 1_000_000)
    return out.select("total", "distinct_n", "global_distinct", F.round("factor", 9).alias("factor"), F.round("mean_chars", 6).alias("mean_chars"), F.round("unique_tokens", 3).alias("unique_tokens"), F.round("epochs", 6).alias("epochs"))


@query("""WITH c AS (SELECT source, sha256(text) AS fp, (doc_id % 6)::INT AS shard FROM documents), f AS (SELECT source, fp, min(shard) AS shard FROM c GROUP BY ALL), n AS (SELECT shard, count(*) AS n FROM c GROUP BY shard), w AS (SELECT shard, count(*) AS new FROM f GROUP BY shard)
SELECT shard, sum(n) OVER o::BIGINT AS total, sum(coalesce(new, 0)) OVER o::BIGINT AS distinct_n, round(sum(n) OVER o::DOUBLE / sum(coalesce(new, 0)) OVER o, 9) AS factor FROM n LEFT JOIN w USING (shard) WINDOW o AS (ORDER BY shard)""".replace("sum(n) OVER o::BIGINT", "(sum(n) OVER o)::BIGINT").replace("sum(coalesce(new, 0)) OVER o::BIGINT", "(sum(coalesce(new, 0)) OVER o)::BIGINT").replace("sum(n) OVER o::DOUBLE", "(sum(n) OVER o)::DOUBLE"))
def dedup_running(spark, d):
    own = table(spark, d, "documents").select("source", "text", (F.col("doc_id") % 6).cast("int").alias("shard"))
    return audit.running(own).withColumn("factor", F.round("factor", 9))


@query(f"""WITH d AS (SELECT *, {BUCKET} AS shard FROM {READY}), c AS (SELECT source, shard, doc_id * 100000 + unnest(range(0, len(c))) AS pos, unnest(c) AS text FROM (SELECT *, {S.chunks('t', 500)} AS c FROM d)),
g AS (SELECT *, -ln({S.ratio(S.quote('17'), 'source', 'pos::VARCHAR')} * 0.999999::DOUBLE + 5e-7) / (1.0 + (substr(source, 4)::INT % 5)) AS gap FROM c), a AS (SELECT *, sum(gap) OVER (PARTITION BY source ORDER BY pos) AS arrival FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY arrival, source, pos) AS rn FROM a), u AS (SELECT * FROM r WHERE rn <= 60 + shard * 10)
SELECT source, count(*) AS total, count(DISTINCT text) AS distinct_n, round(count(*)::DOUBLE / count(DISTINCT text), 9) AS factor FROM u GROUP BY source""")
def replay_audit(spark, d):
    """Audit of what shards took: split, chunks, mix, then the first chunks of each shard by its recorded number."""
    from tessera.operators import mix

    own = ready(spark, d).select("doc_id", "source", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("shard"), F.posexplode(T.text_chunks("t", 500)).alias("i", "text"))
    mixed = mix.mix(own.withColumn("pos", F.col("doc_id") * 100000 + F.col("i")), {f"src{i}": 1.0 + i % 5 for i in range(20)}, 17)
    taken = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard"), (60 + F.col("id") * 10).alias("n"))
    return audit.replay(mixed, taken).withColumn("factor", F.round("factor", 9))


def across_sql(shard: str) -> str:
    return f"""(WITH b AS (SELECT sha256(t) AS fp, count(*) AS n, count(DISTINCT {shard}) AS k FROM (SELECT *, {BUCKET} AS bucket FROM {READY}) GROUP BY 1)
SELECT sum(n)::BIGINT AS total, count(*) AS distinct_n, sum(k - 1)::BIGINT AS collisions, round(sum(n)::DOUBLE / count(*), 9) AS factor, sum(n)::DOUBLE / count(*) <= 1.01 AS passed FROM b)"""


@query(f"SELECT 'hash' AS dealt, * FROM {across_sql('bucket')} UNION ALL SELECT 'position', * FROM {across_sql('doc_id % 5')}")
def verify_shards(spark, d):
    own = ready(spark, d).select("doc_id", "t", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"))
    one = lambda name, shard: audit.across_shards(own.withColumn("shard", shard), ids=None, text="t").select(F.lit(name).alias("dealt"), "total", "distinct_n", "collisions", F.round("factor", 9).alias("factor"), "passed")
    return one("hash", F.col("bucket")).unionAll(one("position", F.col("doc_id") % 5))


@query(f"SELECT 0 AS pos, 'documents' AS \"check\", count(*) > 0 AS passed FROM documents UNION ALL SELECT 1, 'disjoint', max(k) <= 1 FROM (SELECT count(DISTINCT {BUCKET}) AS k FROM {READY} GROUP BY source, t) UNION ALL SELECT 2, 'benchmark', count(*) >= 8 FROM benchmark")
def preflight(spark, d):
    own = ready(spark, d).groupBy("source", "t").agg(F.count_distinct(T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS)).alias("k"))
    checks = [
        ("documents", not table(spark, d, "documents").isEmpty(), ""), ("disjoint", (own.agg(F.max("k")).first()[0] or 0) <= 1, "equal rows share a shard"), ("benchmark", table(spark, d, "benchmark").count() >= 8, ""),
    ]
    return audit.preflight(spark, checks).select("pos", "check", "passed")


# --- run metrics: a run is a user, its steps the user's events in time ----------------------------------------------------

SERIES = """series AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss, value * (1 + event_id % 7) AS grad_norm, 1e-5::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lr,
  epoch(ts)::DOUBLE AS seconds, event_id, CASE WHEN event_id % 4 = 0 THEN value END AS eval_loss FROM events)"""


def series(spark, d):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    own = table(spark, d, "events").withColumn("step", step)
    return own.select(
        F.col("user_id").alias("run"), "step", F.col("value").alias("loss"), (F.col("value") * (1 + F.col("event_id") % 7)).alias("grad_norm"), (F.lit(1e-5) * F.col("step")).alias("lr"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("seconds"),
        "event_id", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("eval_loss"),
    )


EMA = f"WITH RECURSIVE {SERIES}, e AS (SELECT run, step, loss, loss AS s FROM series WHERE step = 1 UNION ALL SELECT x.run, x.step, x.loss, 0.7::DOUBLE * e.s + (1 - 0.7::DOUBLE) * x.loss FROM e JOIN series x ON x.run = e.run AND x.step = e.step + 1)"


@query(f"{EMA} SELECT run, step, round(s, 6) AS smoothed FROM e")
def ema(spark, d):
    return M.ema(series(spark, d)).select("run", "step", F.round("smoothed", 6).alias("smoothed"))


@query(f"{EMA} SELECT run, round(min(s), 6) AS min_loss, arg_min(step, s) AS min_step FROM e GROUP BY run")
def ema_minimum(spark, d):
    return M.smoothed_minimum(M.ema(series(spark, d))).withColumn("min_loss", F.round("min_loss", 6))


@query(f"""{EMA}, q AS (SELECT series.*, s, count(*) OVER (PARTITION BY series.run) AS n FROM series JOIN e USING (run, step)), r AS (SELECT * FROM q WHERE n >= 10),
g AS (SELECT run, greatest(any_value(n) // 2, 1) AS mid, list_sort(list(grad_norm) FILTER (step <= greatest(n // 2, 1))) AS l FROM r GROUP BY run), lo AS (SELECT run, min(s) AS ml, arg_min(step, s) AS ms FROM r GROUP BY run),
h AS (SELECT r.*, ml, ms, l[mid // 2 + 1] AS base FROM r JOIN g USING (run) JOIN lo USING (run)),
c AS (SELECT run, arg_min(lr, step) FILTER (step >= ms AND (grad_norm > base * 3 OR loss > ml * 1.15::DOUBLE OR s > ml * 1.3::DOUBLE)) AS hit, arg_max(lr, step) AS last, max(lr) FILTER (step = ms) AS sweet, any_value(ml) AS ml FROM h GROUP BY run)
SELECT run, round(coalesce(hit, last), 9) AS ceiling_lr, round(sweet, 9) AS sweet_spot_lr, round(ml, 6) AS min_loss, hit IS NULL AS warned, round(coalesce(hit, last) / 3, 9) AS center FROM c""")
def lr_ceiling(spark, d):
    out = M.lr_ceiling(series(spark, d))
    return out.select("run", F.round("ceiling_lr", 9).alias("ceiling_lr"), F.round("sweet_spot_lr", 9).alias("sweet_spot_lr"), F.round("min_loss", 6).alias("min_loss"), "warned", F.round("center", 9).alias("center"))


@query(f"""WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM series), k AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM n WHERE n < 20 OR step > greatest(n // 10, 1))
SELECT run, coalesce(bool_or(n >= 20 AND loss > low * 8.0::DOUBLE), false) AS has_spike FROM k GROUP BY run""")
def spikes_running_min(spark, d):
    return M.spikes(series(spark, d), threshold=8.0)


def warm_sql(last: str) -> str:
    return f"""WITH {SERIES}, b AS (SELECT run, min(loss) AS base FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM series WHERE step <= 20) WHERE {last} GROUP BY run),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS rn, count(*) OVER (PARTITION BY run) AS n FROM series WHERE step > 20), h AS (SELECT run, bool_or(loss > base * 1.2::DOUBLE) AS s FROM p JOIN b USING (run) WHERE rn <= greatest(n // 3, 1) GROUP BY run)
SELECT run, coalesce(s, false) AS has_spike FROM (SELECT DISTINCT run FROM series) LEFT JOIN h USING (run)"""


@query(warm_sql("rn <= 5"))
def spikes_post_warmup(spark, d):
    return M.post_warmup_spikes(series(spark, d), 20)


@query(warm_sql("true"))
def spikes_canary(spark, d):
    return M.post_warmup_spikes(series(spark, d), 20, last=None)


GRID = """grid AS (SELECT event_id % 50 AS grid, event_id AS pos, value / 1000 AS lr, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE 2 + (event_id % 13) / 1000.0::DOUBLE END AS eval_loss, 2.005::DOUBLE AS train_loss, event_id % 3 = 0 AS has_spikes,
  value * 100 AS tok_per_s, event_id % 11 = 0 AS failed, event_id % 8 AS grad_accum, (event_id % 6) / 100.0::DOUBLE AS warmup_ratio FROM events)"""


def grid(spark, d):
    e = F.col("event_id")
    eval_loss = F.when(e % 9 == 0, 0.0).when(e % 7 == 0, None).otherwise(2 + (e % 13) / 1000.0)
    return table(spark, d, "events").select(
        (e % 50).alias("grid"), e.alias("pos"), (F.col("value") / 1000).alias("lr"), eval_loss.cast("double").alias("eval_loss"), F.lit(2.005).alias("train_loss"), (e % 3 == 0).alias("has_spikes"), (F.col("value") * 100).alias("tok_per_s"),
        (e % 11 == 0).alias("failed"), (e % 8).alias("grad_accum"), ((e % 6) / 100.0).alias("warmup_ratio"),
    )


SCORED = f"{GRID}, sc AS (SELECT *, coalesce(nullif(eval_loss, 0), nullif(train_loss, 0), 999.0) AS score FROM grid), b AS (SELECT *, min(score) OVER (PARTITION BY grid) AS best FROM sc)"


@query(f"""WITH {SCORED}, f AS (SELECT grid, arg_min(lr, row(score, pos)) AS first FROM b GROUP BY grid), c AS (SELECT grid, min(lr) AS lr FROM b WHERE NOT has_spikes AND score <= best + 0.02::DOUBLE GROUP BY grid)
SELECT grid, round(coalesce(c.lr, f.first), 9) AS lr, round(f.first, 9) AS rank_one FROM f LEFT JOIN c USING (grid)""")
def grid_winner(spark, d):
    a, b = M.grid_winner(grid(spark, d)), M.grid_winner(grid(spark, d), margin=None).withColumnRenamed("lr", "rank_one")
    return a.join(b, "grid").select("grid", F.round("lr", 9).alias("lr"), F.round("rank_one", 9).alias("rank_one"))


@query(f"WITH {GRID}, v AS (SELECT *, max(tok_per_s) OVER (PARTITION BY grid) AS best FROM grid WHERE NOT failed) SELECT grid, arg_max(grad_accum, pos) AS grad_accum FROM v WHERE tok_per_s >= best * 0.95::DOUBLE GROUP BY grid")
def throughput_choice(spark, d):
    return M.throughput_choice(grid(spark, d))


@query(f"WITH {GRID} SELECT grid, min(warmup_ratio) FILTER (NOT has_spikes) AS warmup_ratio FROM grid GROUP BY grid")
def warmup_choice(spark, d):
    return M.warmup_choice(grid(spark, d).withColumn("spike", F.col("has_spikes")))


@query(f"""WITH {SERIES}, t AS (SELECT *, first_value(seconds) OVER w AS t0, lag(seconds) OVER w AS t1, lag(step) OVER w AS s1 FROM series WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, round(CASE WHEN seconds > t0 THEN step / (seconds - t0) * 1024 END, 6) AS average_rate, round(CASE WHEN seconds > t1 THEN (step - s1) / (seconds - t1) * 1024 END, 6) AS interval_rate FROM t""")
def throughput(spark, d):
    return M.rates(series(spark, d), 1024).select("run", "step", F.round("average_rate", 6).alias("average_rate"), F.round("interval_rate", 6).alias("interval_rate"))


@query(f"WITH {SERIES} SELECT run, step, last_value(eval_loss IGNORE NULLS) OVER (PARTITION BY run ORDER BY step) AS recent FROM series")
def eval_as_of(spark, d):
    return M.as_of(series(spark, d), "run", "step", "eval_loss", "recent").select("run", "step", "recent")


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY coalesce(eval_loss, 'inf'::DOUBLE), step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b FROM series) SELECT run, step, (a <= 3 OR b <= 3 OR step IN (7, 14)) AS keep FROM r""")
def checkpoint_retention(spark, d):
    return M.retained(series(spark, d), milestones=[7, 14]).select("run", "step", "keep")


@query(f"""WITH {SERIES}, m AS (SELECT *, max(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM series) SELECT run, step, best, min(step) FILTER (loss = best) OVER (PARTITION BY run, best) AS best_step FROM m""")
def best_so_far(spark, d):
    return M.best_so_far(series(spark, d), value="loss").select("run", "step", "best", "best_step")


@query(f"""WITH {SERIES}, p AS (SELECT step, ['all', 'b', 'a'][event_id % 3 + 1] AS subset, run, event_id, loss FROM series), f AS (SELECT step, subset, arg_min(loss, event_id) AS loss FROM p GROUP BY step, subset)
SELECT step, round(max(loss) FILTER (subset = 'all'), 6) AS all_loss, round(max(loss) FILTER (subset = 'a'), 6) AS a_loss, round(max(loss) FILTER (subset = 'b'), 6) AS b_loss FROM f GROUP BY step HAVING max(loss) FILTER (subset = 'all') IS NOT NULL""")
def eval_pivot(spark, d):
    subset = F.get(F.array(F.lit("all"), F.lit("b"), F.lit("a")), (F.col("event_id") % 3).cast("int"))
    own = series(spark, d).select("step", subset.alias("subset"), "event_id", "loss").groupBy("step", "subset").agg(F.min_by("loss", "event_id").alias("loss"))
    return M.eval_pivot(own, ["a", "b", "all"]).select("step", *(F.round(f"{n}_loss", 6).alias(f"{n}_loss") for n in ("all", "a", "b")))


NAMES = ["eval_loss", "eval_runtime", "eval_math_samples_per_second", "loss", "eval_x_steps_per_second", "train_runtime"]


@query(f"SELECT event_id, [{', '.join(map(S.quote, NAMES))}][event_id % 6 + 1] AS metric FROM events WHERE event_id % 6 IN (0, 3, 5)")
def metric_filter(spark, d):
    own = table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 6).cast("int")).alias("metric"))
    return M.without_speed(own)


@query("""WITH n AS (SELECT user_id AS run, count(*) AS n, sum(event_id % 1000 + 1)::BIGINT AS tokens FROM events GROUP BY user_id), e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT run, step, round(1e-6::DOUBLE * exp(ln(1e-2::DOUBLE / 1e-6::DOUBLE) * step / n), 12) AS lr, 32 * (run % 4 + 1) AS tokens_per_step, ceil(tokens::DOUBLE / (32 * (run % 4 + 1)))::BIGINT AS max_steps FROM e JOIN n USING (run)""")
def lr_sweep(spark, d):
    """The rate of a geometric sweep at each step of each run, and the steps of the run's token budget."""
    own = table(spark, d, "events")
    sizes = own.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 1000 + 1).alias("tokens"))
    steps = own.select(F.col("user_id").alias("run"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("step"))
    per_step = M.tokens_per_step(F.lit(8), F.col("run") % 4 + 1, F.lit(4))
    return steps.join(sizes, "run").select("run", "step", F.round(M.swept_rate(1e-6, 1e-2, F.col("step"), F.col("n")), 12).alias("lr"), per_step.alias("tokens_per_step"), M.step_budget(F.col("tokens"), per_step).alias("max_steps"))


# --- quantiles, means, counts ----------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT source, list_sort(list(length(text))) AS s FROM documents GROUP BY source), q AS (SELECT *, len(s) AS n FROM l), e AS (SELECT *, least(greatest((n + 1) * 9 // 10, 1), n - 1) AS j FROM q)
SELECT source, round(quantile_cont(length(text), 0.9), 6) AS linear, any_value(s[round_even((n - 1) * 0.9, 0)::INT + 1]) AS nearest, round(any_value((s[j] * (10 - ((n + 1) * 9 - j * 10)) + s[j + 1] * ((n + 1) * 9 - j * 10)) / 10.0::DOUBLE), 6) AS exclusive,
  floor(median(length(text)))::BIGINT AS p50 FROM e JOIN documents USING (source) GROUP BY source""")
def quantiles(spark, d):
    own = table(spark, d, "documents").select("source", F.length("text").alias("n"))
    own = M.quantiles(own, ["source"], "n", {"linear": M.linear(0.9), "nearest": M.nearest(0.9), "exclusive": M.exclusive(10, 9), "p50": M.linear(0.5)})
    own = own.withColumn("nearest", F.col("nearest").cast("int")).withColumn("p50", F.floor("p50"))
    return own.select("source", F.round("linear", 6).alias("linear"), "nearest", F.round("exclusive", 6).alias("exclusive"), "p50")


@query("SELECT lang, count(*) AS n, sum(n_chars)::DOUBLE / greatest(count(*), 1) AS mean FROM documents GROUP BY lang UNION ALL SELECT 'none', 0, 0.0")
def guarded_means(spark, d):
    df = table(spark, d, "documents")
    by = df.groupBy("lang").agg(F.count("*").alias("n"), M.guarded_mean("n_chars").alias("mean"))
    none = df.where("false").agg(F.lit("none").alias("lang"), F.count("*").alias("n"), M.guarded_mean("n_chars").alias("mean"))
    return by.unionAll(none)


@query("WITH b AS (SELECT event_id // 32 AS batch, avg(value) AS l FROM events GROUP BY 1) SELECT round(avg(l), 6) AS loss, round(ln(CASE WHEN avg(l) < 30 THEN exp(avg(l)) ELSE 'inf'::DOUBLE END), 6) AS log_perplexity FROM b")
def batch_mean_loss(spark, d):
    own = table(spark, d, "events").select(F.floor(F.col("event_id") / 32).alias("batch"), F.col("value").alias("loss"))
    return M.batch_mean(own, "batch").select(F.round("loss", 6).alias("loss"), F.round(T.log("perplexity"), 6).alias("log_perplexity"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def source_counts(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


# --- joins and sets ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT text FROM documents)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'except', count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT text FROM documents WHERE doc_id % 2 = 1)""")
def set_operations(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    even, odd = docs.where("doc_id % 2 = 0").select("text"), docs.where("doc_id % 2 = 1").select("text")
    got = {"union": docs.select("text").unionByName(bench.select("text")), "distinct": docs.select("text").distinct(), "intersect": even.intersect(odd), "except": even.subtract(odd)}
    out = None
    for op, df in got.items():
        one = df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT 'semi' AS op, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT 'anti', count(*) FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'left', count(*) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'inner', count(*) FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 UNION ALL SELECT 'cross', count(*) FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents)""")
def join_kinds(spark, d):
    docs, labels, conv = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "conversations")
    after = conv.select("conv_id", (F.col("turn") - 1).alias("turn"))
    got = {
        "semi": docs.join(labels, "doc_id", "left_semi"), "anti": docs.join(labels, "doc_id", "left_anti"), "left": docs.join(labels, "doc_id", "left"), "inner": conv.join(after, ["conv_id", "turn"]),
        "cross": docs.select("source").distinct().crossJoin(docs.select("lang").distinct()),  # checkpoints by tasks: both are lists of names
    }
    out = None
    for op, df in got.items():
        one = df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    """The batch form of streaming.tumbling."""
    own = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    start = F.col("w.start")
    return own.select((start.cast("timestamp_ntz") if dict(table(spark, d, "events").dtypes)["ts"] == "timestamp_ntz" else start).alias("start"), "event_type", "n", "total")


# --- records and files of runs -------------------------------------------------------------------------------------------------

CHECKPOINTS = """(SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'checkpoint-' || (event_id % 500) WHEN 1 THEN 'checkpoint-' || (event_id % 40) || 'B-tokens' WHEN 2 THEN 'other-' || (event_id % 30) ELSE 'final' END AS name FROM events)"""


def checkpoint_names(spark, d):
    e = F.col("event_id")
    name = F.when(e % 4 == 0, F.concat(F.lit("checkpoint-"), e % 500)).when(e % 4 == 1, F.concat(F.lit("checkpoint-"), e % 40, F.lit("B-tokens"))).when(e % 4 == 2, F.concat(F.lit("other-"), e % 30)).otherwise("final")
    return table(spark, d, "events").select(name.alias("name")).distinct()


@query(f"""WITH n AS {CHECKPOINTS}, l AS (SELECT name, length(name) / 10.0::DOUBLE AS eval_loss FROM n WHERE length(name) % 2 = 0), s AS (SELECT name, length(name)::BIGINT AS global_step, length(name) / 4.0::DOUBLE AS state_loss FROM n WHERE length(name) % 3 = 0)
SELECT name, coalesce(eval_loss, state_loss) AS eval_loss, global_step, CASE WHEN regexp_full_match(name, 'checkpoint-[0-9]+(B-tokens)?') THEN 1 ELSE 2 END AS class FROM n LEFT JOIN l USING (name) LEFT JOIN s USING (name) WHERE contains(name, 'checkpoint')""")
def checkpoint_filter(spark, d):
    from tessera.sources import checkpoints

    n = checkpoint_names(spark, d)
    size = F.length("name")
    loss = n.where(size % 2 == 0).select("name", (size / 10).alias("eval_loss"))
    state = n.where(size % 3 == 0).select("name", size.cast("long").alias("global_step"), (size / 4).alias("eval_loss"))
    return checkpoints(n, loss, state, contains="checkpoint").select("name", "eval_loss", "global_step", F.col("key.class").alias("class"))


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY coalesce(eval_loss, 'inf'::DOUBLE), step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b FROM series)
SELECT run, step, a <= 2 OR b <= 1 OR step IN (5, 10, 20) AS keep FROM r""")
def checkpoint_milestones(spark, d):
    return M.retained(series(spark, d), best=2, last=1, milestones=[5, 10, 20]).select("run", "step", "keep")


@query("SELECT event_id, value::FLOAT AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, (value / 3)::FLOAT FROM events WHERE event_id % 2 = 1")
def aligned_types(spark, d):
    own = table(spark, d, "events")
    even, odd = own.where("event_id % 2 = 0").select("event_id", "value"), own.where("event_id % 2 = 1").select("event_id", (F.col("value") / 3).alias("value"))
    return even.select(T.narrow_doubles(even.dtypes)).unionByName(odd.select(T.narrow_doubles(odd.dtypes)))


@query("SELECT doc_id FROM documents WHERE doc_id % 20 > 8 AND doc_id % 13 > 8")
def long_rows(spark, d):
    from tessera.operators import chat

    filled = lambda n: F.array_repeat(F.lit(7), (F.col("doc_id") % n).cast("int"))
    return table(spark, d, "documents").select("doc_id", filled(20).alias("input_ids"), filled(13).alias("labels")).where(chat.long_enough()).select("doc_id")


@query("""WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN '' END AS role, CASE WHEN turn % 2 = 1 THEN role || '!' END AS speaker, role AS "from", CASE WHEN conv_id % 3 = 0 THEN text END AS content, CASE WHEN conv_id % 3 = 1 THEN text ELSE '' END AS "value", text || '.' AS text FROM conversations)
SELECT conv_id, turn, coalesce(nullif(role, ''), nullif(speaker, ''), "from") AS role, coalesce(nullif(content, ''), nullif("value", ''), text) AS content FROM f""")
def field_aliases(spark, d):
    from tessera.operators import chat

    t, c, role, text = F.col("turn"), F.col("conv_id"), F.col("role"), F.col("text")
    roles = [F.when(t % 3 == 0, role).when(t % 3 == 1, F.lit("")), F.when(t % 2 == 1, F.concat(role, F.lit("!"))), role]
    contents = [F.when(c % 3 == 0, text), F.when(c % 3 == 1, text).otherwise(""), F.concat(text, F.lit("."))]
    return table(spark, d, "conversations").select("conv_id", "turn", chat.alias_fields(roles, contents).alias("m")).select("conv_id", "turn", "m.role", "m.content")


@query("""SELECT 'documents' AS name, (SELECT min(column_name) FROM (DESCRIBE documents) WHERE column_name IN ('text', 'content', 'paragraph', 'data')) AS column
UNION ALL SELECT 'pages', CASE WHEN trim(url) <> '' THEN 'url' WHEN trim(html) <> '' THEN 'html' END FROM (SELECT * FROM pages ORDER BY page_id LIMIT 1)
UNION ALL SELECT 'nation', CASE WHEN trim(n_name) <> '' THEN 'n_name' END FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1)""")
def text_columns(spark, d):
    from tessera.sources import text_column

    keys = {"documents": "doc_id", "pages": "page_id", "nation": "n_nationkey"}
    return spark.createDataFrame([(n, text_column(table(spark, d, n), k)) for n, k in keys.items()], "name string, column string")
