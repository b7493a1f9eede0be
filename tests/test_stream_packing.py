import random
import time

from pyspark.sql import functions as F

from tessera.operators import pack
from tessera.streaming import packing

SCHEMA = "shard string, pos long, n int"


def docs(df):
    """Rows with as many ids as n says, which tell where they come from."""
    return df.select("shard", "pos", F.transform(F.slice(F.sequence(F.lit(0), F.lit(60)), 1, F.col("n")), lambda i: (F.col("pos") * 100 + i).cast("int")).alias("ids"))


def test_a_stream_gives_the_blocks_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("abc"), i, r.choice([0, 1, 7, 13, 60])) for i in range(400)] + [("only", 400, 3)]
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(part):
        spark.createDataFrame(r.sample(part, len(part)), SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        time.sleep(0.05)  # files are taken in the order of their times

    cuts = [0, 90, 91, 250, 401]
    for lo, hi in zip(cuts[:2], cuts[1:3], strict=True):
        arrive(rows[lo:hi])
    packing.pack_arriving(spark, docs, inbox, SCHEMA, out, state, "shard", "pos", 16).awaitTermination()
    half = packing.packed_blocks(spark, out).count()
    for lo, hi in zip(cuts[2:4], cuts[3:], strict=True):  # the query is started anew and goes on
        arrive(rows[lo:hi])
    for _ in range(2):  # the second start finds nothing new
        packing.pack_arriving(spark, docs, inbox, SCHEMA, out, state, "shard", "pos", 16).awaitTermination()
    got = packing.packed_blocks(spark, out).select("shard", "block_id", "input_ids")
    want = pack.blocks(docs(spark.createDataFrame(rows, SCHEMA)), ["shard"], "pos", 16).select("shard", "block_id", "input_ids")
    assert 0 < half < got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_counts_in_the_same_pass(spark, tmp_path):
    from tessera.streaming import progress

    inbox, said = str(tmp_path / "in"), []
    for k in range(3):
        spark.createDataFrame([("a", 10 * k + i, 5) for i in range(10)], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    watching = progress.watch(spark, every=60, report=said.append)
    try:
        stream = progress.counted(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox), F.col("n"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if q.id in watching.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watching)
    assert watching.totals[q.id] == {"rows": 30, "texts": 30, "tokens": 150} and watching.ended[q.id] is None
    assert [t["tokens"] for t in watching.triggers[q.id] if t["rows"]] == [50, 50, 50]
    assert [x["tokens"] for x in said] == [100, 150]


def test_no_python_task_holds_a_shard_of_a_trigger(spark, tmp_path):
    """A trigger with one large shard is packed by ranges; a trigger that is tried again leaves the same blocks and state; null shards and null ids are kept apart."""
    rows = [(None if i % 50 == 7 else "big", i * 7 % 4000, None if i % 97 == 0 else [i] * (i % 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "shard string, pos long, ids array<int>").repartition(8)
    parts = [df.where("pos < 3100"), df.where("pos >= 3100 and pos < 3500"), df.where("pos >= 3500"), df.where("false")]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n in (0, 1, 1, 2, 3):
        packing.pack_trigger(parts[n], n, out, state, "shard", "pos", 16)
    got = packing.packed_blocks(spark, out).select("shard", "block_id", "input_ids").collect()
    want = []
    for shard in ("big", None):
        own = sorted((r for r in rows if r[0] == shard), key=lambda r: r[1])
        flat = [x for r in own for x in r[2] or ()]
        want += [(shard, i // 16, flat[i : i + 16]) for i in range(0, len(flat) - 15, 16)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = {r.shard: (r.next_block, r.rest) for r in spark.read.parquet(f"{state}/{packing.STATES}/trigger=3").collect()}
    assert len(left) == 2 and all(n == sum(w[0] == s for w in want) and len(rest) < 16 for s, (n, rest) in left.items())
