from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import text as T


def test_staged_files_equal_the_batch(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"s{i % 3}", f" text {i} ") for i in range(60)] + [(99, "s0", "  ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.repartition(4).write.parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        q = streaming.stage(spark, inbox, "doc_id long, source string, text string", out, str(tmp_path / "cp"), "salt", 0.3, 4)
        q.awaitTermination()
    got = spark.read.option("basePath", out).parquet(out).withColumn("is_eval", F.col("is_eval").cast("boolean"))
    want = streaming.staged_columns(df, "salt", 0.3, 4)
    key = lambda x: sorted((r.doc_id, r.text, r.is_eval, r.shard, r.fp) for r in x.select("doc_id", "text", "is_eval", "shard", "fp").collect())
    assert key(got) == key(want) and got.count() == 60
    assert 0 < got.where("is_eval").count() < 60
    assert got.where(T.in_holdout(F.col("source"), F.col("text"), "salt", 0.3) != F.col("is_eval")).count() == 0


def test_event_time(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", "a", 1.0, "s", f"t{h % 2}") for h in range(6)] + [("2024-01-01 00:20:00", "a", 2.0, "s", "t0")]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double, source string, text string").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "e")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    for name, q, mode in (("w", streaming.tumbling(stream), "complete"), ("d", streaming.deduplicated(stream, delay="9 hours").select("text"), "append")):
        run = q.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
    got = {r.start.hour: (r.n, r.total) for r in spark.table("w").collect()}
    assert got[0] == (2, 3.0) and len(got) == 6
    assert sorted(r.text for r in spark.table("d").collect()) == ["t0", "t1"]
