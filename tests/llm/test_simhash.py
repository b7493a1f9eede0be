import random
import re

import xxhash

from tessera.llm import simhash
from tessera.llm.components import connected


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps.items():
            for j, b in fps.items():
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_random_texts_and_edges(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["ÄB", "x y"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 300))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    texts += texts[:5] + [None, "", "  \n\t ", "one", "One", "one two three"]
    check(spark, texts)


def test_ball_links_against_brute_force(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for d in range(1, 7):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    fps |= {0, 1, (1 << 64) - 1, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for prefix, room in ((16, 4_000_000), (20, 4_000_000), (16, 3000)):
        df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        found = connected(simhash.ball_links(df, prefix, room)).collect()
        root = {x.node & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in found}
        want = brute_components({signed(f): f for f in fps})
        assert {f: signed(root.get(f, f)) for f in fps} == {f: want[signed(f)] for f in fps}


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_keeps_columns_and_one_of_a_group(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (9, "q r s t u v w x", 4)], "doc_id long, text string, fp int")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or -1), r.fp) for r in out.collect()) == [(-1, 3), (1, 2), (9, 4)]
