import bisect
import random
from collections import defaultdict

from tessera.operators import audit, sketches


def chunks(n=40_000):
    r = random.Random(4)
    return [(r.randrange(5), r.choice(["a", "a", "b"]), f"chunk {r.randrange(9000)} " + "x" * r.randrange(300)) for _ in range(n // 2)] + [(r.randrange(5), "c", f"same {r.randrange(50)}") for _ in range(n // 2)]


def test_estimates_stay_within_their_bounds(spark):
    rows = chunks()
    df = spark.createDataFrame(rows, "shard int, source string, text string")
    store = sketches.stored(df).cache()
    exact = {r.source: r for r in audit.per_source(df).collect()}
    lengths = defaultdict(list)
    for _, s, t in rows:
        lengths[s].append(len(t))
    for r in sketches.audit(store).collect():
        assert r.total == exact[r.source].total
        assert abs(r.distinct_n - exact[r.source].distinct_n) <= 4 * sketches.DISTINCT_ERROR * exact[r.source].distinct_n + 1
        own = sorted(lengths[r.source])
        for q, x in zip((0.5, 0.9, 0.99), r.lengths, strict=True):
            low, high = bisect.bisect_left(own, x) / len(own), bisect.bisect_right(own, x) / len(own)
            assert max(0, low - q, q - high) <= 4 * sketches.RANK_ERROR
    by_shard = {r.shard: r for r in audit.running(df).collect()}
    for r in sketches.running(store).collect():
        assert r.total == by_shard[r.shard].total and abs(r.distinct_n - by_shard[r.shard].distinct_n) <= 4 * sketches.DISTINCT_ERROR * r.distinct_n + 1
    texts = defaultdict(set)
    for s, _, t in rows:
        texts[s].add(t)
    for r in sketches.overlaps(store).collect():
        a, b = texts[r.left], texts[r.right]
        assert abs(r.common - len(a & b)) <= 4 * sketches.OVERLAP_ERROR * len(a | b) + 1
    total = sketches.summary(store, 2, 1000).first()
    assert total.total == len(rows) and abs(total.distinct_n - sum(e.distinct_n for e in exact.values())) <= 4 * sketches.DISTINCT_ERROR * total.distinct_n + 1


def test_order_and_increments_do_not_matter(spark):
    df = spark.createDataFrame(chunks(6000), "shard int, source string, text string").cache()
    whole = {tuple(r) for r in sketches.audit(sketches.stored(df)).select("source", "total", "distinct_n").collect()}
    for order in ([0, 1, 2, 3, 4], [3, 1, 4, 0, 2]):
        store = state = None
        for s in order:
            new = df.where(f"shard = {s}")
            store = sketches.add(store, new)
            state = sketches.continued(state, sketches.stored(new))
        assert {tuple(r) for r in sketches.audit(store).select("source", "total", "distinct_n").collect()} == whole
        assert {tuple(r) for r in sketches.audit(state).select("source", "total", "distinct_n").collect()} == whole
    again = sketches.add(sketches.stored(df), df.where("shard = 2"))  # a shard that comes again replaces its rows
    assert {tuple(r) for r in sketches.audit(again).select("source", "total", "distinct_n").collect()} == whole
    assert sketches.audit(sketches.stored(df.limit(0))).count() == 0
