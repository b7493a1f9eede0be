import random

from tessera.llm import substring_dedup


def brute(rows, span):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for s in range(len(w) - span + 1) if first[tuple(w[s : s + span])] < i for j in range(s, s + span)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["Aa", "aa", "b", "cé", "d", "e,", "f g"]
    passage = r.choices(vocab, k=70)
    texts = []
    for _ in range(60):
        w = r.choices(vocab, k=r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            at, cut = r.randint(0, len(w)), r.randint(0, 30)
            w[at:at] = passage[cut : cut + r.randint(5, 60)]
        texts.append("".join(x + r.choice([" ", "\n", "\t ", "\u000b"]) for x in w))
    texts += texts[:4] + [None, "", " ", "x " * 200, "x " * 120, " ".join(passage)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for span, k in ((12, 5), (50, 16)):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.dedup(df, span, k).collect()}
        assert got == brute(rows, span)


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in substring_dedup.dedup(df, 5, 2).collect()}
    assert got == {None: 0, 1: 0, 2: 6}
    assert substring_dedup.dedup(df.limit(0), 5, 2).count() == 0


def test_hot_anchors_give_the_same_result(spark):
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(300)]
    passage = r.choices(vocab, k=40)
    rows = []
    for i in range(300):
        w = r.choices(vocab, k=r.randint(0, 40))
        at = r.randint(0, len(w))
        w[at:at] = passage[r.randint(0, 5) :] if i % 2 else passage
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(substring_dedup.hot_anchors(df, 12, 5, "doc_id", "text", 1, 1)) > 0
    want = brute(rows, 12)
    for hot, share in ((1, 1), (10**9, 16)):
        ranges = substring_dedup.repeats(df, 12, 5, hot=hot, share=share).collect()
        gone = {i: set() for i, _ in rows}
        for x in ranges:
            gone[x.doc_id].update(range(x.first, x.last))
        assert {i: len(g) for i, g in gone.items()} == {i: n for i, (_, n, _) in want.items()}


def test_rows_of_one_id_are_told_apart(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, a), (2, b)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed, x.kept) for x in substring_dedup.dedup(df, 5, 2).collect())
    assert got == [(1, 0, a), (2, 0, b), (2, 0, b), (2, 10, ""), (2, 10, "")]
