import random

import numpy as np

from tessera.llm import weak_quality as Q


def test_scorer_learns_without_labels(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 8)))

    def prose():
        return " ".join(word() + r.choice(["", "", "", "", "", ",", "."]) for _ in range(r.randint(60, 300))) + "."

    junk = [lambda: " ".join(w.upper() + "!!" for w in prose().split()), lambda: " ".join(w + "$$$" for w in prose().split()), lambda: " | ".join(prose().split()), lambda: " ".join(w for w in prose().split()[:20] for _ in range(15))]
    rows = [(i, r.choice(junk)() if i % 6 == 0 else prose()) for i in range(600)]
    df = spark.createDataFrame([*rows, (601, None), (602, ""), (None, rows[1][1])], "doc_id long, text string")
    got = {x.doc_id: x for x in Q.scores(df, sample_rows=300).collect()}
    assert len(got) == 603 and all(0 <= x.score <= 1 for x in got.values())
    good = [got[i].predicted == int(i % 6 != 0) for i, _ in rows]
    assert sum(good) >= 0.97 * len(good)
    assert Q.scores(df.limit(0)).count() == 0


def test_a_long_text_does_not_turn_all_good(spark):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(90)) + "."
    rows = [(i, " ".join(w.upper() + "!!" for w in prose().split()) if i % 5 == 0 else prose()) for i in range(300)]
    rows += [(1000 + i, "word " * 30_000 + str(i)) for i in range(40)]
    got = {x.doc_id: x.predicted for x in Q.scores(spark.createDataFrame(rows, "doc_id long, text string"), sample_bytes=100_000).collect()}
    assert sum(got[i] == int(i % 5 != 0) for i in range(300)) >= 290


def test_ties_repeats_and_clashing_names(spark):
    rows = [(i % 7, "some words that say little. " * (i % 3 + 1), "x", 0.5, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, bytes double, score int")
    got = Q.scores(df).collect()
    assert len(got) == 60 and got[0].__fields__ == ["doc_id", "posterior", "score", "predicted"]
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add((x.posterior, x.score))
    assert all(len(v) <= 3 for v in by.values())


def test_expectation_maximisation_against_plain_loops():
    r = np.random.default_rng(3)
    k = len(Q.LABELLERS)
    rows = r.integers(0, 3, (400, k))
    rows[r.random(400) < 0.6] = rows[0]
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    got = Q.Outcomes().fit(patterns, counts.astype(float), rounds=7)
    start = Q.Outcomes()
    prior, rate, anchor = start.prior, start.rate.copy(), start.rate.copy()
    for _ in range(7):
        before, p = rate.copy(), []
        for row in rows:
            good, bad = prior, 1 - prior
            for j, v in enumerate(row):
                good, bad = good * rate[j, 1, v], bad * rate[j, 0, v]
            p.append(good / (good + bad))
        prior = min(max(sum(p) / len(rows), 0.05), 0.99)
        for j in range(k):
            for c in (0, 1):
                seen = [0.05 * len(rows) * anchor[j, c, v] * 0.2 + sum((x if c else 1 - x) for x, row in zip(p, rows, strict=True) if row[j] == v) for v in range(3)]
                rate[j, c] = [max(x / sum(seen), 1e-4) for x in seen]
        if abs(rate - before).max() < 1e-6:
            break
    assert abs(got.prior - prior) < 1e-9 and np.abs(got.rate - rate).max() < 1e-9


def test_scorer_against_plain_gradient_steps():
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "Beta", "gamma!!", "1234", "x"]) for _ in range(r.randint(1, 12))) for _ in range(25)] + [""]
    labels = Q.Outcomes()
    got = Q.train_scorer(texts, labels, rounds=5)
    roll = Q.Rolling(51)
    feats, target = [], []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        w = Q.Words(data, np.array([0, len(data)]), roll)
        f = {}
        for c in w.columns():
            for i in c.tolist():
                f[i] = f.get(i, 0) + 1 / max(int(w.n[0]), 1)
        feats.append(f)
        target.append(float(labels.posterior(w.votes(roll))[0]))
    weights, seen, mean = {}, {}, sum(target) / len(target)
    weights[Q.DIM] = np.log(max(mean, 0.01) / max(1 - mean, 0.01))
    used = {i for f in feats for i in f} | {Q.DIM}
    for _ in range(5):
        grad = {i: 1e-5 * weights.get(i, 0.0) * (i != Q.DIM) for i in used}
        for f, y in zip(feats, target, strict=True):
            gap = (1 / (1 + np.exp(-(sum(x * weights.get(i, 0.0) for i, x in f.items()) + weights[Q.DIM]))) - y) / len(texts)
            for i, x in [*f.items(), (Q.DIM, 1.0)]:
                grad[i] += x * gap
        for i in used:
            seen[i] = seen.get(i, 1e-8) + grad[i] ** 2
            weights[i] = weights.get(i, 0.0) - 0.5 * grad[i] / np.sqrt(seen[i])
    assert all(abs(got[i] - weights[i]) < 1e-4 for i in used)
