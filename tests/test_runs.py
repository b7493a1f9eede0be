import json
import struct

import pytest

from tessera import sources
from tessera.sources import runs


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, kind, data):
    return varint(number << 3 | kind) + (varint(len(data)) + data if kind == 2 else data)


def event(step, values, time=1.5):
    summary = b"".join(field(1, 2, field(1, 2, tag.encode()) + (field(2, 5, struct.pack("<f", v)) if simple else field(8, 2, field(1, 0, varint(1)) + field(4, 2, struct.pack("<f", v))))) for tag, v, simple in values)
    data = field(1, 1, struct.pack("<d", time)) + field(2, 0, varint(step)) + (field(5, 2, summary) if values else field(3, 2, b"brain.Event:2"))
    return runs.record(data)


def test_event_logs_and_their_merge(spark, tmp_path):
    a = event(0, []) + event(1, [("loss", 2.5, True), ("lr", 0.5, False)]) + event(300, [("loss", 1.25, True)])
    b = event(300, [("loss", 1.5, True)]) + event(301, [("loss", 1.0, True)])
    (tmp_path / "events.out.tfevents.1").write_bytes(a)
    (tmp_path / "events.out.tfevents.2").write_bytes(b + b[:9])
    (tmp_path / "events.out.tfevents.0").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    rows = {(r.file[-1], r.tag, r.step): r.value for r in runs.event_logs(spark, str(tmp_path)).collect()}
    assert rows == {("1", "loss", 1): 2.5, ("1", "lr", 1): 0.5, ("1", "loss", 300): 1.25, ("2", "loss", 300): 1.5, ("2", "loss", 301): 1.0}
    merged = {(r.tag, r.step): r.value for r in runs.merged_event_logs(spark, str(tmp_path)).collect()}
    assert merged == {("loss", 1): 2.5, ("lr", 1): 0.5, ("loss", 300): 1.5, ("loss", 301): 1.0}


def test_checkpoint_folders(spark, tmp_path):
    def model(name, **files):
        p = tmp_path / name
        p.mkdir(parents=True)
        (p / "config.json").write_text("{}")
        (p / "model.safetensors").write_text("")
        for f, text in files.items():
            (p / {"loss": ".eval_loss", "state": "trainer_state.json", "summary": "run_summary.json"}[f]).write_text(text)

    model("checkpoint-2B-tokens", loss=" 3.5\n", state=json.dumps({"global_step": None, "epoch": 1}), summary=json.dumps({"global_step": 9, "finished_at": "now"}))
    model("checkpoint-10", loss="none", summary=json.dumps({"global_step": 7}))
    model("final")
    (tmp_path / "no-model").mkdir()
    got = [tuple(r)[:1] + tuple(r)[2:7] for r in runs.discovered_checkpoints(spark, str(tmp_path)).collect()]
    assert got == [("checkpoint-10", None, "none", 7, None, None), ("checkpoint-2B-tokens", 3.5, None, None, 1.0, "now"), ("final", None, None, None, None, None)]
    assert [r.name for r in runs.discovered_checkpoints(spark, str(tmp_path), contains="B-tok").collect()] == ["checkpoint-2B-tokens"]
    assert runs.discovered_checkpoints(spark, str(tmp_path / "none")).count() == 0


def test_timeouts_mirrors_and_text_columns(spark, tmp_path):
    import time

    with pytest.raises(TimeoutError, match="Opening x timed out"):
        sources.timed(lambda: time.sleep(2), 0.05, "Opening x")
    waits = []
    with pytest.raises(TimeoutError):
        sources.with_retries(lambda: sources.timed(lambda: time.sleep(1), 0.01, "x"), tries=3, sleep=waits.append)
    assert waits == [2.0, 4.0]
    df = spark.createDataFrame([(1, " ", "words")], "id long, a string, b string")
    df.write.parquet(f"{tmp_path}/set/train")
    df.write.json(f"{tmp_path}/set/other/test")
    assert sources.mirrored(spark, str(tmp_path), "set").count() == sources.mirrored(spark, str(tmp_path), "set", "other", "test").count() == 1
    assert sources.opened(spark, sources.Source("s", f"{tmp_path}/set/train", 1.0)).count() == 1
    with pytest.raises(ValueError):
        sources.mirrored(spark, str(tmp_path), "none")
    assert sources.text_column(df) == "b" and sources.text_column(df.withColumnRenamed("a", "data")) == "data"
    with pytest.raises(ValueError):
        sources.text_column(df.select("id"))
