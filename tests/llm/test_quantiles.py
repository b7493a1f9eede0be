import bisect
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import quantiles, queries


def held(rows, got, least_points=20, most=2000, parts=20):
    """Every statement of the contract about rows (group, batch, x), by brute force."""
    every = defaultdict(list)
    for *g, b, x in rows:
        every[(*g, b)].append(x)
        every[(*g, -1)].append(x)
    found = defaultdict(dict)
    for r in got:
        found[tuple(r)[: -(len(r) - r.__fields__.index("i"))]][r.i] = r
    want = {k for k, v in every.items() if len(v) >= parts}
    assert set(found) == want
    for k, of in found.items():
        xs = sorted(every[k])
        n, d = len(xs), len(set(xs))
        assert sorted(of) == list(range(1, parts))
        answers = [of[i].answer for i in range(1, parts)]
        assert answers == sorted(answers)
        for i, r in of.items():
            target = -(-i * n // parts)
            below, upto = bisect.bisect_left(xs, r.answer), bisect.bisect_right(xs, r.answer)
            error = max(0, below + 1 - target, target - upto)
            assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto, r.rank_error, r.within) == (n, target, xs[target - 1], below, upto, error, True), (k, r)
            assert xs[0] <= r.answer <= xs[-1] and 1000 * error <= 10 * n
            assert min(least_points, d) <= r.points <= min(n, most)


def rows_of(r):
    out = [("hot", r.randrange(16), int(r.gauss(0, 1) * 10**6)) for _ in range(60_000)]
    out += [("skew", b, 7) for b in range(4) for _ in range(9000)] + [("skew", r.randrange(4), r.randrange(-50, 5000)) for _ in range(9000)]
    out += [("shifted", b, b * 1000 + r.randrange(3000)) for b in range(16) for _ in range(700)]
    out += [("exp", r.randrange(3), int(r.expovariate(1) ** 6 * 1000)) for _ in range(20_000)]
    out += [("one", 0, 5)] * 3000 + [("few", r.randrange(2), r.randrange(3)) for _ in range(4000)]
    out += [(f"s{k}", r.randrange(16), r.randrange(100)) for k in range(60) for _ in range(r.randint(1, 120))]
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows = rows_of(random.Random(5))
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "g string, batch int, x long, c int, n string").cache()


def test_summaries_against_brute_force(spark, case):
    rows, df = case
    held(rows, quantiles.summarise(df, ["g"]).collect())


def test_small_pieces_and_bounds_split_again(spark, case):
    """Pieces of few values, no plain groups and fine slots: several rounds, over several tasks a bucket."""
    rows, df = case
    held(rows, quantiles.summarise(df.repartition(5), ["g"], limits=quantiles.Limits(piece=300, plain=0)).collect())


def test_buckets_are_bounded_and_exact(spark, case):
    rows, df = case
    from pyspark.sql import functions as F

    limits = quantiles.Limits(slots=100, piece=500)
    got = quantiles.buckets(df.groupBy("g", "batch", "x").agg(F.count("*").alias("c")), ["g", "batch"], limits).collect()
    values = defaultdict(list)
    for g, b, x in rows:
        values[g, b].append(x)
    edges = defaultdict(list)
    for r in got:
        edges[r.g, r.batch].append((r.x, r.w, r.m))
    assert set(edges) == set(values)
    for k, xs in values.items():
        low = None
        for x, w, m in sorted(edges[k]):
            inside = [v for v in xs if v <= x and (low is None or v > low)]
            assert len(inside) == w and inside.count(x) == m
            assert w <= len(xs) // 100 or len(set(inside)) == 1
            low = x
        assert low == max(xs)


def test_odd_rows(spark):
    rows = [("a", 0, 1, 30), ("a", 0, None, 3), (None, 0, 1, 50), ("a", None, 1, 50), ("b", 0, 2, 0), ("c", 3, 9, 19), ("c", 4, 9, 1)]
    df = spark.createDataFrame(rows, "low string, batch int, x long, c long")  # a group named as an inner column
    got = quantiles.summarise(df, ["low"])
    assert got.columns == ["low", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
    held([("a", 0, 1)] * 30 + [("c", 3, 9)] * 19 + [("c", 4, 9)], got.collect())
    assert quantiles.summarise(df.limit(0), ["low"]).count() == 0


def test_query(spark, tmp_path):
    r = random.Random(8)
    clicks = [(i, r.choice([7, 7, 7, *range(40), None]), r.choice([None, float("nan"), r.lognormvariate(3, 2), 2.5])) for i in range(4000)]
    clicks += r.sample(clicks, 300)
    items = [(i, r.choice(["A", "B", "C", None]), r.choice([None, round(r.uniform(1, 90), 2), 3.125])) for i in range(300)]
    lines = [(s, 1, r.choice([5, r.randrange(320), None]), r.choice([None, r.randrange(30)])) for s in range(6000)]
    spark.createDataFrame(clicks, "click_id long, client_id long, value double").write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(items, "item_id long, brand string, price double").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long").write.parquet(f"{tmp_path}/sale_lines.parquet")
    import math

    batch = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 16
    x = lambda m, b: math.floor(100 * m + 0.5) + 1000 * b
    want = [("value", str(g), batch(i), x(v, batch(i))) for i, g, v in {c[0]: c for c in clicks}.values() if g is not None and v is not None and v == v]
    of = {i: (b, p) for i, b, p in items if b is not None and p is not None}
    want += [("price", of[i][0], batch(v), x(of[i][1], batch(v))) for _, _, i, v in lines if i in of]
    got = queries.op11_quantiles(spark, str(tmp_path))
    assert got.columns == ["stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
    held(want, got.collect())
