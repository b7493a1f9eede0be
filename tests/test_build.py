import json

import pytest
from pyspark.sql import functions as F

from tessera import sources as S
from tessera.operators import audit, chat
from tessera.plans import build as B
from tessera.sources import sinks


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    spark.createDataFrame([(f"document {i} of a " + " ".join(f"word{i * j}x{i}" for j in range(i % 20)),) for i in range(400)], "text string").write.parquet(str(d / "a"))
    (d / "b.jsonl").write_text("\n".join(json.dumps({"body": f"entry {i} of b " + " ".join(f"term{i * j}y{i}" for j in range(i % 15))}) for i in range(300)))
    return d


def config(d, **more):
    own = {"holdout_rate": 0.1, "holdout_salt": "s", "long_text_chunk_chars": 60}
    return S.BuildConfig([S.Source("x/a", str(d / "a"), 3.0, chatml_wrap_rate=0.3, **own), S.Source("b", str(d / "b.jsonl"), 1.0, kind="json", text_fields=["body"], **own)], seed=4, block_size=128, shard_tokens=3000, **more)


def test_build_shards(spark, inputs, tmp_path):
    root = str(tmp_path / "out")
    m = B.build(spark, config(inputs, num_shards=3), root).orderBy("shard_id").collect()
    assert [(r.shard_id, r.blocks, r.complete) for r in m] == [(i, 24, True) for i in range(3)]
    blocks = S.shards(spark, root)
    assert audit.across_shards(blocks.withColumnRenamed("shard_id", "shard")).first().passed
    again = str(tmp_path / "again")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    B.build(spark, config(inputs, num_shards=3), again)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert blocks.exceptAll(S.shards(spark, again)).count() == 0
    meta = json.loads(spark.read.text(f"{root}/meta", wholetext=True).first()[0])
    by = {s["source"]: s for s in meta["sources"]}
    for source, n in (("x/a", 400), ("b", 300)):
        own = B.prepared(spark, config(inputs, num_shards=3)).where(F.col("source") == source)
        whole, many, wrapped = own.where("chunk_no = 0").count(), own.where("chunk_no = 0 and is_chunked").count(), own.where("wrapped").count()
        assert by[source] == {"source": source, "seen": n, "accepted": whole, "skipped": n - whole, "chunks": own.count(), "chunked": many, "wrapped": wrapped}
    assert by["x/a"]["wrapped"] > 0 == by["b"]["wrapped"]
    assert sum(r["tokens"] for r in meta["tokenised"]) <= 3 * 24 * 128 * 1.1 + 3 * 200
    with pytest.raises(ValueError, match="ran out"):
        c = config(inputs, num_shards=3)
        c.shard_tokens = 10_000_000
        B.build(spark, c, str(tmp_path / "more"))
    assert sinks.drop_incomplete(spark, str(tmp_path / "more")) == [0, 1, 2]


def test_only_what_the_budget_reaches_is_tokenised(spark, tmp_path):
    """Texts of which a token takes a varying number of bytes: a few rounds, a small rest beyond the budget, and the blocks of all."""
    from tessera.operators import mix, pack
    from tessera.plans.lineage import cut

    df = cut(spark.range(4000).select(F.col("id").alias("__row"), F.when(F.col("id") < 900, F.repeat(F.lit("ab "), 30)).otherwise(F.repeat(F.lit("longer words "), 9)).alias("text")), "t")
    order = cut(df.select("__row", (F.col("__row") % 3).cast("int").alias("shard_id"), F.col("__row").alias("mix_pos"), F.octet_length("text").cast("long").alias("bytes")), "o")
    whole = order.join(df, "__row").select("shard_id", "mix_pos", "text")

    def words(x):
        return x.select("shard_id", "mix_pos", F.transform(F.split(F.rtrim("text"), " "), lambda w: F.length(w)).alias("ids"))

    want = mix.token_budget(pack.blocks(words(whole), ["shard_id"], "mix_pos", 64), 12_000, 64)
    ids, rounds = B.within_budget(df, order, words, -(-12_000 // 64) * 64, guess=2.0)
    got = mix.token_budget(pack.blocks(ids, ["shard_id"], "mix_pos", 64, lengths="n"), 12_000, 64)
    assert got.count() == want.count() == 3 * 188 and got.exceptAll(want).count() == 0
    assert 2 <= len(rounds) <= 5 and 36_096 <= sum(r["tokens"] for r in rounds) <= 36_096 * 1.1 < words(whole).select(F.sum(F.size("ids"))).first()[0]


def test_nothing_written_on_the_way_stays(spark, inputs, tmp_path):
    from tessera.plans.lineage import shared_dir

    place = shared_dir(spark).removeprefix("file://")
    import os

    before = set(os.listdir(place))
    B.build(spark, config(inputs, num_shards=2), str(tmp_path / "out"))
    assert set(os.listdir(place)) == before


def test_eval_suite(spark, inputs, tmp_path):
    root = str(tmp_path / "suite")
    c = config(inputs)
    c.shard_tokens = 640
    canary = spark.createDataFrame([("probe one",), ("probe two",)], "text string")
    assert B.eval_suite(spark, c, root, canary) == ["x/a", "b", "canary"]
    assert B.eval_suite(spark, c, root, canary) == []
    suite, metric = B.load_suite(spark, root, ["x_a", "b", "canary"])
    n = {r.subset: r["count"] for r in suite.groupBy("subset").count().collect()}
    assert metric == "eval_all_loss" and n == {"x_a": 5, "b": 5, "canary": 1, "all": 11}


def test_build_chat(spark, tmp_path):
    say = "These are some plain words that make an answer long enough to pass all of the rules here"
    rows = [(f"s{i % 2}", i, [("user", f"What about thing number {i} and what else is there to say?"), ("assistant", say + f" for {i}")]) for i in range(20)]
    df = spark.createDataFrame(rows, "source string, conv_id long, messages array<struct<role:string,content:string>>")
    root = str(tmp_path / "chat")
    B.build_chat(spark, df, root, 256, weights={"s0": 1.0, "s1": 1.0}, rows=15)
    out = S.shards(spark, root)
    assert out.count() == 15
    s = chat.row_summary(out, 256).first()
    assert s.rows_checked == 15 and s.supervised_rows == 15 and s.seq_len_p50 == 256 and s.first_supervised_p50 >= 32
    assert out.where(chat.long_enough()).count() == 15
    with pytest.raises(Exception, match="no supervised"):
        chat.row_summary(out.withColumn("labels", F.transform("labels", lambda x: F.lit(-100))), 256).collect()
    with pytest.raises(Exception, match="bad lengths"):
        chat.row_summary(out, 8).collect()
    assert chat.tree_or_messages(df.drop("source")).count() == 20


def test_report_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 0), ("a", "x", 1), ("b", "y", 1)], "source string, text string, shard int")
    audit.report(df, 2, 100, str(tmp_path / "r"))
    got = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert got["totals"]["total"] == 3 and [s["source"] for s in got["per_source"]] == ["a", "b"] and len(got["shard_results"]) == 2
    (tmp_path / "f").write_bytes(b"abc")
    import hashlib

    assert sinks.file_sha256(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
