import random
import zlib

from tessera.llm import toxicity


def rows(n=1500, seed=3):
    r = random.Random(seed)
    syllables = ["ra", "ti", "no", "be", "lu", "ka", "shi", "mo"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 80))]
        label = int(i % 8 == 0)
        if label:
            for _ in range(r.randint(2, 4)):
                w.insert(r.randrange(len(w)), r.choice(["grobl" + word(), "idiot", "vexon" + word()]))
        out.append((i, " ".join(w), label))
    return out


def test_held_out_accuracy_and_contract(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(9001, None, "x"), (9002, "", "x"), (None, "you idiot", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"grobl", "vexon"} <= set(model.lexicon.stems)
    out = toxicity.scores(docs, model).select("*", toxicity.held_out("doc_id").alias("held_out")).collect()
    truth = {i: y for i, _, y in data}
    assert len(out) == len(data) + 3
    for r in out:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in test) >= 0.98 * len(test)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.score < 0.3}


def test_grammar():
    lexicon = toxicity.Lexicon()
    one = lambda t: {k: v for k, v in toxicity.matched(t, lexicon).items() if v}
    assert one("You are an idiot. Nice day.") == {"directed": 1}
    assert one("an idiot went home") == {"plain": 1}
    assert one("He is not a moron") == {"negated": 1}
    assert one("she said you are stupid") == {"reported": 1}
    assert one("I will kill you") == {"threat": 1}
    assert one("kill the process, idiotic") == {}
    assert one("") == {}


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot"), (2, "fine words")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert got[1] > 0.5 > 0.3 > got[2]
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_a_long_text_does_not_stop_learning(spark):
    """The first text of the sample is larger than all that may be fetched: an excerpt stands in, the others stay."""
    data = rows()
    ids = [i for i, _, _ in data]
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    long = {i: "ra ti no " * 40_000 for i in order[:2]}
    docs = spark.createDataFrame([(i, long.get(i, t)) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_bytes=300_000)
    assert {"grobl", "vexon"} <= set(model.lexicon.stems) and list(model.weights) != list(toxicity.Model.FIXED)
    assert list(toxicity.train(docs, labels, sample_bytes=1000).weights) is not None


def test_long_rows_are_fitted_singly(spark):
    from tessera.llm.shared import excerpt, fitting

    assert fitting([(1, 10_000), (2, 50), (3, None), (4, 60), (5, 40)], 200, 100) == [1, 2, 3, 5]
    df = spark.createDataFrame([("short é",), ("".join(f"{i:05d}" for i in range(20_000)),), (None,)], "t string")
    a, b, c = (r[0] for r in df.select(excerpt(df.t, 4096)).collect())
    assert a == "short é" and c is None and len(b) <= 4096 and b.startswith("00000") and b.endswith("19999")
