import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import queries, toxicity

COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"], "op2": ["doc_id", "fingerprint", "component_id"], "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op7": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"],
    "op13": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op10": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


def tables(spark, path, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    docs = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(r.randint(8, 25))) for _ in range(r.randint(1, 5))]
        if i % 9 == 4:
            lines.insert(1, items[i % 5][1])
        if i % 6 == 1:
            lines[0] += " idiot moron scum"
        if i % 10 == 2:
            lines[-1] += f" mail me.{i}@host-{i}.example.org or +1 (444) 555-3382, card 4539 1488 0343 6467, ip 10.0.0.{i}"
        if i % 7 == 3:
            lines[0] = docs[0][1].split("\n")[0]
        docs.append((i, "\n".join(lines), "en", "s", 0))
    docs += [(200 + k, docs[k][1], "en", "s", 0) for k in range(6)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    labels = [(i, 1, int(i % 6 == 1)) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>x y</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, 1, float(i)) for i in range(25)], "click_id long, client_id long, value double").write.parquet(f"{path}/clicks.parquet")
    spark.createDataFrame([(1, "B", 2.5)], "item_id long, brand string, price double").write.parquet(f"{path}/items.parquet")
    spark.createDataFrame([(1, 1, 1, 3)], "sale_id long, line_no int, item_id long, vendor_id long").write.parquet(f"{path}/sale_lines.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return docs, items


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    return path, *tables(spark, path)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_contract_columns(spark, case, name):
    out = entry.queries()[name](spark, case[0])
    op = name.split("_")[0]
    if op in COLUMNS:
        assert [c for c in out.columns if c in COLUMNS[op]] == COLUMNS[op]
    assert out.count() == {"op1": 2, "op11": 19, "op12": 2, "op13": 0}.get(op, len(case[1]))


def test_pipeline_against_its_stages_by_brute_force(spark, case):
    from test_decontaminate import brute as contaminated
    from test_line_dedup import brute as lines
    from test_simhash import brute_components, brute_fp

    path, docs, items = case
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), labels)
    kept = [(d[0], d[1]) for d in docs if model.score(d[1] or "") < 0.3]
    assert {i for i, _ in kept} == {d[0] for d in docs if "idiot" not in (d[1] or "")}
    kept = list(lines(kept).items())
    label = brute_components({i: brute_fp(t) for i, t in kept})
    kept = [(i, t) for i, t in kept if label[i] == i]
    bad = {i for i, _, n, _ in contaminated(kept, items) if n}
    want = {i: t or "" for i, t in kept if i not in bad}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.decoded for r in got} == want
    assert all(r.n_tokens == len(r["ids"]) for r in got)


def test_stages_keep_the_columns_of_documents(spark, case):
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, case[0])
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)


def test_pii_digest(spark, case):
    from hashlib import sha256

    from test_pii import brute

    texts = {d[0]: d[1] or "" for d in case[1]}
    rows = queries.op6_pii(spark, case[0]).collect()
    assert any(r.n_card for r in rows) and any(r.n_phone for r in rows)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        joined = ",".join(":".join(map(str, b)) for b in base)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest() and r.spans == joined


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h string, version int, rows int, gone string, i int, v int, c0 string, n_lines int, stays int"


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, rows repeated with one id, nulls, and extra columns of names that the operators use inside."""
    path = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    extra = ("h", 1, 2, "g", 3, 4, "c", 5, 6)
    rows = [(1, "a line of words here\nand another line", "en", "s", 3, *extra), (1, "a line of words here\nand another line", "en", "s", 3, *extra), (1, "unlike text of the same id", "en", "s", 3, *extra), (None, None, None, None, None, *[None] * 9), (7, None, None, None, None, *extra), (8, "", "en", "s", 0, *extra)]
    full = spark.createDataFrame(rows, EXTRA)
    for docs in (full, full.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            got = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns
            if name in ("toxicity", "line_dedup", "decontamination", "bpe"):
                assert len(got) == n, name
            if name == "simhash" and n:
                assert sorted(str(r.text) for r in got) == sorted(["None", "None", "a line of words here\nand another line", "unlike text of the same id"])


def test_queries_on_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string"), ("clicks", "click_id long, client_id long, value double"), ("items", "item_id long, brand string, price double"), ("sale_lines", "sale_id long, line_no int, item_id long, vendor_id long")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        assert q(spark, path).count() == (1 if name == "op12_chat_format" else 0), name  # the conversation -7 is always there
    assert corpus_pipeline.run(spark, path).count() == 0


def test_line_dedup_on_odd_rows(spark):
    from tessera.llm import line_dedup

    text = "A line of words that is long enough\nshort\n\nA line of words that is long enough"
    rows = [(1, text, "x", 1), (1, text, "x", 2), (1, "a line of words that is long enough\nother", "x", 3), (2, None, "y", 4), (None, text, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_lines int")
    out = {r.n_lines: r.text for r in line_dedup.dedup(df, whole=True).collect()}
    kept = {out[1], out[2], out[3]}
    # equal rows keep the same lines; of the two texts of id 1 one holds the line, the other lost it
    assert out[1] == out[2] and out[4] is None and out[5] == text
    assert sum(t.lower().count("a line of words that is long enough") for t in kept) == 1
    report = line_dedup.dedup(df, whole=True, report=True)
    assert report.columns == ["doc_id", "text", "gone", "n_lines", "n_removed_lines"] and sorted(r.n_lines for r in report.collect()) == [0, 2, 4, 4, 4]


def test_one_very_long_text_grows_memory_little(spark):
    """Words, hashes and windows of 30 MB in one text, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, %r)
import numpy as np, pyarrow as pa
from tessera.llm import decontaminate as D
words = ["w%%d" %% (i * 7919 %% 100003) for i in range(200_000)]
text = " ".join(words * 22)[:30_000_000]
col = pa.array([text], pa.string())
index = D.Index([("1", " ".join(words[50:80])), ("2", "short item")], 10, 6)
del words
low = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for lo, hi, part, s, e, first in D._texts(col):
    begin, end, item = index.hits(index.byte.spans(part, s, e), np.repeat(np.arange(hi - lo), np.diff(first)), first)
    n += len(begin)
assert n > 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - low) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code % entry.__file__.rsplit("/", 1)[0]], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 900, out.stdout
