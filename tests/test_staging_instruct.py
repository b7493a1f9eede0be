import random

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import instruct
from tessera.plans import staging


def test_staged_work_needs_no_exchange(spark, tmp_path):
    rows = [(i, f"s{i % 7}", i % 5, f"text {i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, shard_id int, text string")
    a = staging.stage_table(df, "staged_a", str(tmp_path / "a"), 8, ["doc_id"])
    b = staging.stage_table(df.select("source", "shard_id", F.col("doc_id").alias("other")), "staged_b", str(tmp_path / "b"), 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dup, off, joined = staging.duplicates(a), staging.offsets(a, "doc_id", F.length("text")), a.join(b, staging.KEYS).groupBy(*staging.KEYS).count()
        assert [staging.exchanges(x) for x in (dup, off, joined)] == [0, 0, 0]
        assert staging.exchanges(staging.duplicates(df)) > 0
        assert sorted(map(tuple, dup.collect())) == sorted(map(tuple, staging.duplicates(df).collect()))
        assert sorted(map(tuple, off.collect())) == sorted(map(tuple, staging.offsets(df, "doc_id", F.length("text")).select(*off.columns).collect()))
        assert joined.agg(F.sum("count")).first()[0] == sum(n * n for n in spark.table("staged_a").groupBy(*staging.KEYS).count().toPandas()["count"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("staged_a", "staged_b"):
            staging.drop_table(spark, t)


def test_instruction_rows_by_a_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    # a merge crosses the border between prompt and response
    t = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(["\n", "a", "b", ":", "#", " ", *"InstructoRepse", "\na"]) if c}, merges=[("\n", "a")], unk_token=None))
    t.pre_tokenizer = None or pre_tokenizers.Sequence([])
    t.save(str(tmp_path / "t.json"))
    rows = [("b", None, "ab"), ("b", "a", "ba"), (" ", "", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    out = instruct.instruction_rows(df, 64, str(tmp_path / "t.json"), eos=99, least=0).collect()
    first = out[0]
    assert t.id_to_token(first.input_ids[-3]) == "\na" and first.labels[-3] == fixed.IGNORED  # it begins in the prompt
    assert first.input_ids[-1] == first.labels[-1] == 99 and first.labels[-2] == t.token_to_id("b")
    assert [len(r.input_ids) == len(r.labels) == len(r.attention_mask) for r in out] == [True] * 4
    assert all(x == fixed.IGNORED for x in out[2].labels[:-1]) and out[2].labels[-1] == 99
    assert instruct.instruction_rows(df, 64, str(tmp_path / "t.json"), eos=99, least=0, end_learnt=False).first().labels[-1] == fixed.IGNORED


def test_instruction_rows_are_cut_and_filtered(spark):
    r = random.Random(1)
    rows = [(i, "do é it", r.choice(["", "with", None]), "x" * r.randrange(0, 80)) for i in range(50)]
    df = spark.createDataFrame(rows, "labels long, instruction string, input string, output string")
    got = instruct.instruction_rows(df.withColumnRenamed("labels", "k"), 70)
    for x in got.collect():
        _, ins, inp, out = rows[x.k]
        prompt = f"### Instruction:\n{ins}\n\n" + (f"### Input:\n{inp}\n\n" if inp else "") + "### Response:\n"
        ids = [b + fixed.BYTE_SHIFT for b in (prompt + out).encode()]
        n = len(prompt.encode())
        labels = ([fixed.IGNORED] * n + ids[n:])[:70] + ([fixed.EOS] if len(ids) < 70 else [])
        assert x.input_ids == ids[:70] + ([fixed.EOS] if len(ids) < 70 else []) and x.labels == labels
    assert instruct.instruction_rows(df, 8).count() == 0
