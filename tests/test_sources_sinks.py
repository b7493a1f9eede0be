import json

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import audit, mix, pack, tokens
from tessera.plans.prefix import global_rank, running_sum
from tessera.sources import sinks


def docs(spark, n=40):
    return spark.createDataFrame([(i, f"s{i % 3}", f" text number {i} " * (i % 5)) for i in range(n)], "pos long, source string, text string")


def blocks(spark):
    ids = tokens.byte_ids(docs(spark).withColumn("shard_id", (F.col("pos") % 3).cast("int")))
    return pack.blocks(ids, ["shard_id"], "pos", 32)


def test_shards_round_trip(spark, tmp_path):
    root = str(tmp_path / "root")
    b = blocks(spark)
    m = sinks.write_shards(b, root, "train", 1, 32)
    assert [r.complete for r in m.collect()] == [True] * 3
    assert sources.train_shards(spark, root) == [0, 1, 2]
    assert sources.shards(spark, root).count() == b.count()
    assert {r.shard_id for r in sources.shards(spark, root, limit=2).select("shard_id").distinct().collect()} == {0, 1}
    assert sources.shards(spark, root, most_rows=3).count() == 3
    with pytest.raises(ValueError, match="complete already"):
        sinks.write_shards(b, root, "train", 1, 32)
    assert sinks.next_shard(m, 5) == 3
    with pytest.raises(ValueError, match="all 3"):
        sinks.next_shard(m, 3)
    plan = sources.shards(spark, root, limit=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_incomplete_shards(spark, tmp_path):
    root = str(tmp_path / "root")
    b = blocks(spark)
    most = max(r["count"] for r in b.groupBy("shard_id").count().collect())
    small = b.where(f"shard_id > 0 or block_id < {most - 2}") if False else b.where("shard_id <> 1 or block_id < 1")
    m = sinks.write_shards(small, root, "train", 2, 32)
    with pytest.raises(ValueError, match="incomplete"):
        sources.shards(spark, root)
    assert {r.shard_id for r in sources.shards(spark, root, strict=False).select("shard_id").distinct().collect()} == {0, 2}
    with pytest.raises(ValueError, match="incomplete"):
        sinks.next_shard(m, 9)


def test_packing_conserves_tokens_for_any_partitioning(spark):
    ids = tokens.byte_ids(docs(spark, 200))
    flat = [t for r in ids.orderBy("pos").collect() for t in r.ids]
    for n in (1, 7):
        out = pack.blocks(ids.repartition(n), [], "pos", 48).orderBy("block_id").collect()
        assert [r.block_id for r in out] == list(range(len(flat) // 48))
        assert [t for r in out for t in r.input_ids] == flat[: len(out) * 48]
        padded = pack.blocks(ids.repartition(n), [], "pos", 48, tail="pad").orderBy("block_id").collect()
        assert sum(sum(r.attention_mask) for r in padded) == len(flat)
        assert all((x == -100) == (m == 0) for r in padded for x, m in zip(r.labels, r.attention_mask))


def test_prefix_and_rank(spark):
    df = spark.createDataFrame([(k, i, float(i * k % 7)) for k in range(3) for i in range(50)], "k int, i long, v double")
    for span in (1, 8, 1000):
        got = {(r.k, r.i): r.s for r in running_sum(df, ["k"], "i", "v", "s", parts=span).collect()}
        for k in range(3):
            total = 0.0
            for i in range(50):
                assert got[k, i] == total
                total += i * k % 7
    ranks = {(r.k, r.i): r.n for r in global_rank(df, "v", ["k", "i"], "n", parts=4).collect()}
    assert [key for key, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(ranks, key=lambda x: (float(x[1] * x[0] % 7), x))
    assert running_sum(df.where("false"), ["k"], "i", "v", "s").count() == 0 and global_rank(df.where("false"), "v", [], "n").count() == 0


def test_mix_is_weighted_and_keeps_order(spark):
    df = spark.range(6000).select((F.col("id") % 2).cast("string").alias("source"), F.floor(F.col("id") / 2).alias("pos"))
    out = mix.mix(df, {"0": 3.0, "1": 1.0}, 5).orderBy("mix_pos").collect()
    head = [r.source for r in out[:2000]]
    assert 0.70 < head.count("0") / 2000 < 0.80
    for s in "01":
        own = [r.pos for r in out if r.source == s]
        assert own == sorted(own)
    assert [r.mix_pos for r in out] == list(range(6000))


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"seed": 7, "partition": "eval", "num_shards": 5, "holdout_rate": 0.02, "sources": [{"name": "a/b", "config_name": "c", "prob": 0.5, "text_fields": ["body"]}, {"data_files": "x.jsonl", "weight": 2}]}))
    c = sources.BuildConfig.load(str(path))
    assert c.num_shards == 1 and c.sources[0].label == "a/b[c]" and c.sources[0].holdout_rate == 0.02 and c.sources[1].kind == "json"
    for bad in ({"sources": [{"name": "a"}]}, {"sources": [{"name": "a", "prob": 0}]}, {"sources": [3]}, {"sources": []}, {"sources": [{"prob": 1}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            sources.BuildConfig.load(str(path))


def test_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1, "b": "y"}\nnot json\n{"text": null, "l": ["z"]}\n[1]\n{"q": "w"}\n')
    assert sorted(r.text for r in sources.lenient_json_texts(spark, str(tmp_path / "a.jsonl")).collect()) == ["w", "x", "y"]
    src = sources.Source("a", {"train": str(tmp_path / "a.jsonl")}, kind="json")
    assert "text" in sources.scan(spark, src).columns
    df = spark.createDataFrame([(1, " ", ["a", " ", "b"], None), (2, " t ", None, "u"), (3, None, None, None)], "id int, text string, content array<string>, extra string")
    got = [(r.id, r.text_no, r.text) for r in sources.texts(df).orderBy("id", "text_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, " t ")]
    star = [(r.id, r.text) for r in sources.texts(df, ["*"]).orderBy("id", "text_no").collect()]
    assert star == [(1, "a"), (1, "b"), (2, " t "), (2, "u")]
    with pytest.raises(ValueError, match="no text column"):
        sources.texts(spark.range(1))
    assert sources.shard_ids("0-2, 4", [0, 1, 2, 3, 4]) == [0, 1, 2, 4]
    with pytest.raises(ValueError, match="not found"):
        sources.shard_ids("0-9", [0, 1])
    tried = []
    assert sources.first_split(lambda s: tried.append(s) or (1 / (s == "b")), ["a", "b"]) == 1 and tried == ["a", "b"]
    waits = []
    flaky = iter([ConnectionError("x"), TimeoutError("y"), None])

    def load():
        if e := next(flaky):
            raise e
        return "ok"

    assert sources.with_retries(load, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        sources.with_retries(lambda: {}["x"], sleep=waits.append)


def test_prompt_file_and_suite(spark, tmp_path):
    from tessera.operators import chat

    (tmp_path / "p.json").write_text(json.dumps(["Hi there", {"user": "Q", "system": "S", "min_words": 3, "id": "own"}, {"messages": [{"role": "USER ", "content": " x "}], "bucket": "fact"}]))
    out = chat.prompt_suite(sources.prompts(spark, str(tmp_path / "p.json"))).collect()
    assert [(r.id, r.bucket, [(m.role, m.content) for m in r.messages]) for r in out] == [("prompt_01", "general", [("user", "Hi there")]), ("own", "general", [("system", "S"), ("user", "Q")]), ("prompt_03", "fact", [("user", "x")])]
    (tmp_path / "bad.json").write_text(json.dumps([{"user": " "}]))
    with pytest.raises(Exception, match="invalid prompt"):
        chat.prompt_suite(sources.prompts(spark, str(tmp_path / "bad.json"))).collect()


def test_reports(spark, tmp_path):
    from tessera.operators.metrics import markdown_table

    df = spark.createDataFrame([("c1", 2.5, "a", 0.5), ("c1", 2.5, "b", 0.25), ("c2", None, "a", 0.125)], "checkpoint string, training_eval_loss double, task string, value double")
    rows = {r.checkpoint: tuple(r)[1:] for r in sinks.comparison_table(df, ["a", "b"]).collect()}
    assert rows == {"c1": ("2.5000", "0.5000", "0.2500"), "c2": ("", "0.1250", "")}
    assert markdown_table(df.where("task = 'b'"), ["checkpoint", "value"]) == "| checkpoint | value |\n| --- | --- |\n| c1 | 0.2500 |\n"
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), append=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(lines) == 6 and list(json.loads(lines[0])) == sorted(df.columns)
    sinks.write_metadata(spark, str(tmp_path / "m"), {"a": 1})
    sinks.write_metadata(spark, str(tmp_path / "m"), {"b": 2})
    meta = json.loads(spark.read.text(str(tmp_path / "m"), wholetext=True).first()[0])
    assert meta["a"] == 1 and meta["b"] == 2 and "created_at" in meta
    sinks.write_corpus(docs(spark).select("pos", "text"), str(tmp_path / "t"), most=5, order="pos")
    assert spark.read.text(str(tmp_path / "t")).count() == 5
    names = spark.createDataFrame([("final", "p"), ("checkpoint-20", "p"), ("checkpoint-1.5B-tokens", "p"), ("checkpoint-3", "p")], "name string, path string")
    loss = spark.createDataFrame([("final", 1.0)], "name string, eval_loss double")
    state = spark.createDataFrame([("checkpoint-3", 2.0, 3), ("final", 9.0, 4)], "name string, eval_loss double, global_step int")
    got = sources.checkpoints(names, loss, state).collect()
    assert [r.name for r in got] == ["checkpoint-3", "checkpoint-20", "checkpoint-1.5B-tokens", "final"]
    assert [r.eval_loss for r in got] == [2.0, None, None, 1.0]
    logs = [spark.createDataFrame([("l", 1, v)], "tag string, step int, value double") for v in (1.0, 2.0)]
    assert [tuple(r) for r in sources.merged_logs(logs).collect()] == [("l", 1, 2.0)]


def test_gates(spark):
    assert audit.shard_guard({0, 1}, {0, 1}, 2) == (0, "ok")
    assert audit.shard_guard({0, 1}, {0}, 2)[0] == 2 and audit.shard_guard({0}, {0}, 2)[0] == 1 and audit.shard_guard(set(), set(), 0)[0] == 1
    b = blocks(spark).withColumnRenamed("shard_id", "shard")
    row = audit.across_shards(b.unionAll(b.withColumn("shard", F.col("shard") + 9))).first()
    assert not row.passed and row.collisions == row.distinct_n
    with pytest.raises(Exception, match="two bytes"):
        audit.across_shards(spark.createDataFrame([(0, [70000])], "shard int, input_ids array<int>")).collect()


def test_tokenizer_file(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.file_ids(spark.createDataFrame([(1, " hello world "), (2, " ")], "i int, text string"), path, bos=1, eos=2).collect()
    assert [(r.i, r.ids[0], r.ids[-1]) for r in got] == [(1, 1, 2)]
    assert all(ok for _, ok, _ in tokens.validate(path, {"<|endoftext|>": 50256}, ["a b", "é中", "\n\n x"]))


def test_rank_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 1.0), (5, 5.0)], "i long, v double")
    for parts in (1, 3, 20):
        got = {r.i: r.n for r in global_rank(df, "v", ["i"], "n", parts=parts).collect()}
        assert got == {1: 0, 3: 1, 4: 2, 2: 3, 5: 4}
    none = spark.createDataFrame([(1, None), (2, None)], "i long, v double")
    assert sorted((r.i, r.n) for r in global_rank(none, "v", ["i"], "n").collect()) == [(1, 0), (2, 1)]


def test_ema_and_quantiles_against_plain_loops(spark):
    import random
    import statistics

    from tessera.operators import metrics as M

    r = random.Random(4)
    rows = [(k, i, None if r.random() < 0.05 else r.random()) for k in ("a", "b", None) for i in range(700)] + [("c", 3, None), ("d", 1, 2.0)]
    df = spark.createDataFrame(rows, "run string, step long, loss double").repartition(5)
    want, last = {}, {}
    for k, i, x in sorted(rows, key=lambda z: (str(z[0]), z[1])):
        s = None if x is None else x if last.get(k) is None else 0.7 * last[k] + 0.3 * x
        want[k, i], last[k] = s, s
    got = {(g.run, g.step): g.smoothed for g in M.ema(df).collect()}
    assert got.keys() == want.keys()
    assert all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())
    small = spark.createDataFrame([("r", i, 0.5 if i else 0.0, float(i)) for i in range(40)], "run string, i long, a double, b double")
    deep, s = {g.i: g.s for g in M.affine_scan(small, "run", block=3).collect()}, 0.0
    for i in range(40):
        s = (0.5 if i else 0.0) * s + i
        assert abs(deep[i] - s) < 1e-9
    values = [("x", v) for v in (5, 1, 4, 4, 2, 9, 7)] + [("y", 3), ("z", None)]
    q = {g.k: g for g in M.quantiles(spark.createDataFrame(values, "k string, v int"), ["k"], "v", {"l": M.linear(0.9), "n": M.nearest(0.5), "e": M.exclusive(4, 1)}).collect()}
    x = sorted(v for k, v in values if k == "x")
    assert set(q) == {"x", "y"} and q["y"].e is None and q["y"].l == q["y"].n == 3
    assert q["x"].n == 4 and abs(q["x"].e - statistics.quantiles(x, n=4)[0]) < 1e-9 and abs(q["x"].l - (7 * 0.6 + 9 * 0.4)) < 1e-9


def test_preflight_of_an_empty_table(spark, tmp_path):
    from tessera.plans import catalog_metrics as C

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [x.passed for x in C.preflight(spark, str(tmp_path)).orderBy("pos").collect()] == [False, True, False]
