import random

import pytest

from tessera.llm import near_docs as N
from tessera.llm import simhash


def shingles(text, k=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, least=0.8):
    """Kept (doc_id, text) by the similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= least * len(a | b):
                x, y = label[i], label[j]
                label = [x if z == y else z for z in label]
    return {min(d for (d, _), g in zip(rows, label, strict=True) if g == k) for k in set(label)}


def corpus(r, n=60):
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 7)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.randint(60, 300))]
        out.append(" ".join(w))
        for share in (0.005, 0.01, 0.02, 0.06):
            v = list(w)
            for _ in range(max(1, int(share * len(w)))):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    r.shuffle(out)
    return out


def test_against_all_pairs(spark):
    rows = [*enumerate(corpus(random.Random(21))), (900, ""), (901, None), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three")]
    kept = [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    want = brute(rows)
    assert len(kept) == len(set(kept))
    gone, due = {i for i, _ in rows} - set(kept), {i for i, _ in rows} - want
    assert len(due) > 100 and len(gone & due) >= 0.95 * len(due)
    # what goes has a similar text among the kept or gone ones: no clean document is lost
    sets = {i: shingles(t) for i, t in rows}
    for i in gone:
        assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)
    assert set(kept) & {900, 901, 902, 903, 904, 905} == {900, 903, 905}


def test_unlike_texts_stay_and_rows_of_one_id_are_told_apart(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (9, "x y z w v u t s", 8), (9, "x y z w v u t s", 7), (None, a, 9)], "doc_id long, text string, i int")
    assert sorted((r.doc_id or -1, r.text, r.i) for r in simhash.near_dedup(df).collect()) == [(-1, a, 9), (3, a, 1), (5, b, 3), (9, "x y z w v u t s", 7)]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 2, "x", "y")], "doc_id long, text string, version int, rows string, h string")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b", 2, "x", "y")]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_large_groups_go_through_several_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    r = random.Random(5)
    base = [str(r.random()) for _ in range(200)]
    texts = []
    for _ in range(40):
        v = list(base)
        v[r.randrange(200)] = str(r.random())
        texts.append(" ".join(v))
    rows = list(enumerate(texts))
    assert [x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


@pytest.mark.parametrize("n", [100, 10**5, 10**8])
def test_plan_holds_its_recall(n):
    bits, number = N.plan(n, 0.8)
    r = random.Random(n)
    found = 0
    for _ in range(400):
        found += any(sum(r.random() < 0.1515 for _ in range(bits)) <= 2 for _ in range(number))
    assert found >= 0.94 * 400
