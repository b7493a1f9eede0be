import random
import re

from tessera.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, span=10):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            x = words(t)
            if not x or i is None:
                continue
            n = min(span, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def case():
    r = random.Random(9)
    vocab = ["The", "a", "Éa", "b2", "c", "ñ"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, "?!"), (103, ""), (None, "a b2 c")]
    docs = []
    for d in range(80):
        w = r.choices([*vocab, "x", "y"], k=r.randint(0, 60))
        if d % 2:
            x = (items[r.randrange(25)][1]).split()
            w[5:5] = x[r.randint(0, 3) :]
        docs.append((d, "".join(t + r.choice([" ", ", ", "-", "\n"]) for t in w)))
    docs += [(90, None), (91, ""), (92, "a"), (None, items[4][1]), (3, docs[3][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (16_000_000, 300):
        got = sorted([(r.doc_id, r.n_words, r.hit_words, list(r["items"])) for r in decontaminate.scan(d, b, block_bytes=block).collect()], key=str)
        assert got == brute(docs, items), block


def test_clean_and_empty(spark):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i) for i, n, h, _ in brute(docs, items) if not h))
    for block in (16_000_000, 400):
        out = decontaminate.clean(d, b, block_bytes=block)
        assert out.columns == d.columns and sorted(str(r.doc_id) for r in out.collect()) == want
    assert decontaminate.scan(d.limit(0), b).count() == 0
    assert {r.hit_words for r in decontaminate.scan(d, b.limit(0)).collect()} == {0}
