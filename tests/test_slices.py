"""Python tasks hold slices of bounded size, whatever number of rows Spark puts into a batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import chat, instruct, slices, tokens


@pytest.fixture
def task(spark, monkeypatch):
    """The function that a query hands to mapInArrow, to be run here on batches of our own."""
    got = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema, *a, **k: got.append(run) or spark.createDataFrame([], schema))
    return got


def test_slices_hold_all_rows_in_order():
    texts = ["", None, "é" * 10, "a" * 500, None, "b", "c" * 64, "d" * 36, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    for own in (b, b.slice(2, 5), b.slice(0, 0)):
        parts = list(slices.by_bytes(own, most=100))
        assert [x for p in parts for x in p.column(0).to_pylist()] == own.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 100 for p in parts)
        assert [p.num_rows for p in slices.by_rows(own, 4)] == [min(4, own.num_rows - i) for i in range(0, own.num_rows, 4)]


def test_byte_ids_by_slices(spark, task):
    tokens.byte_ids(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    texts = [chr(97 + i % 26) * (i % 5000 + 1) for i in range(3000)]
    out = list(task[0]([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "__t"])]))
    assert max(b.nbytes for b in out) <= 5 * slices.TEXT_BYTES < sum(b.nbytes for b in out)
    want = [[fixed.BOS, *(c + fixed.BYTE_SHIFT for c in t.encode()), fixed.EOS] for t in texts]
    assert [x for b in out for x in b.column(1).to_pylist()] == want and [x for b in out for x in b.column(0).to_pylist()] == list(range(3000))


def test_file_ids_by_slices(spark, task, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    tokens.file_ids(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path / "t.json"), bos=7)
    texts = ["a b " * (i % 300) + "c" for i in range(2000)]
    out = list(task[0]([pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "__t"])]))
    assert max(b.nbytes for b in out) <= 5 * tokens.ENCODED_BYTES < sum(b.nbytes for b in out)
    assert [x for b in out for x in b.column(1).to_pylist()] == [[7, *[0, 1] * (i % 300), 2] for i in range(2000)]


def test_instruction_rows_by_slices(spark, task):
    instruct.instruction_rows(spark.createDataFrame([(1, "x", None, "y")], "doc_id long, instruction string, input string, output string"), 512)
    texts = ["p" * 100 + "q" * (i % 412) for i in range(3000)]
    out = list(task[0]([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([100] * 3000), pa.array(texts)], ["doc_id", "__n", "__t"])]))
    assert max(b.num_rows for b in out) < 3000 == sum(b.num_rows for b in out)
    rows = [x for b in out for x in b.column(1).to_pylist()]
    assert rows == [[c + fixed.BYTE_SHIFT for c in t.encode()] + [fixed.EOS] * (len(t) < 512) for t in texts]


def test_long_instruction_texts_are_cut_as_before(spark):
    """Texts beyond the length never reach Python; wide characters, the prompt's end and the end mark stay right."""
    rows = [(1, "é" * 40, None, "ü" * 30), (2, "i", None, "z" * 500), (3, "é" * 200, "x", "o"), (4, "i", None, "ab")]
    got = instruct.instruction_rows(spark.createDataFrame(rows, "doc_id long, instruction string, input string, output string"), 128, least=0).collect()
    for r, (_, i, g, o) in zip(sorted(got), rows, strict=True):
        prompt = f"### Instruction:\n{i}\n\n" + (f"### Input:\n{g}\n\n" if g else "") + "### Response:\n"
        ids = [c + fixed.BYTE_SHIFT for c in (prompt + o).encode()]
        masked = len(prompt.encode())
        labels = [fixed.IGNORED] * masked + ids[masked:]
        end = [fixed.EOS] * (len(ids) < 128)
        assert r.input_ids == ids[:128] + end and r.labels == labels[:128] + end


def test_supervised_rows_by_slices(spark, task):
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("a" * 60).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("b" * 9).alias("content")))
    chat.supervised_rows(spark.range(1).select("id", message.alias("messages")), 2048)
    n = 2000
    text = b"u" * 60 + b"a" * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n, pa.binary()), pa.array([[60, 9]] * n, pa.list_(pa.int32())), pa.array([[False, True]] * n)], ["id", "__w", "__n", "__a"])
    out = list(task[0]([batch, batch.slice(1500)]))
    assert max(b.num_rows for b in out) <= (1 << 20) // 2048 and [x for b in out for x in b.column(0).to_pylist()] == [*range(n), *range(1500, n)]
    assert {tuple(x[60:71]) for b in out for x in b.column(2).to_pylist()} == {(*[97 + fixed.BYTE_SHIFT] * 9, fixed.EOS, fixed.IGNORED)}
