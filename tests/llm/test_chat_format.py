import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from tessera.llm import chat_format

BITS = ["\\", "#", "##", "###", "</turn>", "</turn", "<", ">", ":", ";", "h", "c", ": ", "\n", "é", "日本", "🙂", "word", " ", "\\h", "\\c", "\x00"]


def escape(t, role=False):
    out, i = "", 0
    while i < len(t):
        for what, code in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\c"), *([(":", "\\;")] if role else [])):
            if t.startswith(what, i):
                out, i = out + code, i + len(what)
                break
        else:
            out, i = out + t[i], i + 1
    return out


def brute(turns):
    text, loss = "", []
    for role, t in turns:
        text += f"### {escape(role or '', True)}: "
        body = escape(t or "")
        if role == "assistant":
            loss.append((len(text), len(text) + len(body)))
        text += body + "</turn>\n"
    return text, loss


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "x</turn>", "###", None]), st.one_of(st.none(), st.lists(st.sampled_from(BITS), max_size=12).map("".join))), min_size=1, max_size=4), min_size=1, max_size=4))
def test_assembly_matches_a_plain_writer(chats):
    first = np.cumsum([0, *map(len, chats)])[:-1]
    rows = [x for c in chats for x in c]
    formatted, loss = chat_format.assemble(pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()), first, ["assistant"])
    assert formatted.to_pylist() == [brute(c)[0] for c in chats]
    assert [[(s["start"], s["end"]) for s in x] for x in loss.to_pylist()] == [brute(c)[1] for c in chats]


def cases(seed):
    r = random.Random(seed)
    out = []
    for c in range(150):
        for t in range(r.randint(1, 9)):
            out.append((c, t, r.choice(["user", "assistant", "system", "a: b", "\\", None]), r.choice([None, "", "".join(r.choices(BITS, k=r.randint(1, 30)))]), "extra"))
    return out + [(None, 1, "user", "no id", "x"), (None, 2, "assistant", "none", "x"), (5, 0, "assistant", "a tie", "x"), (5, 0, "assistant", "a tie", "x"), (5, None, "user", "no turn", "x")]


def in_order(rows):
    key = lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r[1:4])
    found = {}
    for r in sorted(rows, key=key):
        found.setdefault(r[0], []).append((r[2], r[3]))
    return found


def test_round_trip_over_tables(spark):
    rows = cases(1)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    want = in_order(rows)
    for frame in (df, df.repartition(1), df.repartition(13)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations go on over batches
        try:
            got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(frame)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == set(want)
        for c, turns in want.items():
            assert (got[c].formatted, [tuple(s) for s in got[c].loss]) == brute(turns)
            assert [tuple(t) for t in got[c].turns] == [(r or "", t or "") for r, t in turns]
            assert got[c].trained == [t or "" for r, t in turns if r == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_texts_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 50)
    long = "#" * 300_001 + "\\" * 5 + "</turn>" * 1000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "é"), (2, 0, "assistant", "x"), *((3, i, "assistant", "y" * 20) for i in range(30))]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, turns in in_order(rows).items():
        assert (got[c].formatted, [tuple(s) for s in got[c].loss]) == brute(turns)


def test_query_has_the_digests(spark, tmp_path):
    from tessera.llm import queries

    rows = [r[:4] for r in cases(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    odd = "\\### Assistant: </turn> ok"
    want = in_order(rows) | {-7: [("user", odd), ("assistant", odd)]}
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[c])[1:] == (len(turns), digest("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), digest(loss), len(brute(turns)[0]))
