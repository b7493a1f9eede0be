import random
import struct

import pytest

from tessera.sources import live_logs, runs


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def scalar(tag, step, value):
    own = b"\x0a" + varint(len(tag)) + tag.encode() + b"\x15" + struct.pack("<f", value)
    summary = b"\x0a" + varint(len(own)) + own
    return runs.record(b"\x09" + struct.pack("<d", 1.5) + b"\x10" + varint(step) + b"\x2a" + varint(len(summary)) + summary)


def test_checksums():
    assert runs.crc32c(b"123456789") == 0xE3069283
    assert runs.crc32c(bytes(32)) == 0x8A9136AA
    assert runs.masked(struct.pack("<Q", 24)) == runs.masked(struct.pack("<Q", 24)) != runs.crc32c(struct.pack("<Q", 24))


@pytest.fixture
def run(spark, tmp_path):
    folder, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def once(**options):
        live_logs.live_event_logs(spark, str(folder), **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file[-1], r.tag, r.step, r.value) for r in spark.read.schema(live_logs.SCHEMA).parquet(out).collect())

    return folder, once


def test_a_growing_log_gives_each_record_once(run):
    folder, once = run
    r = random.Random(2)
    data = {n: b"".join(scalar("loss", i, i / 4) for i in range(60)) for n in "ab"}
    done = dict.fromkeys(data, 0)
    for turn in range(4):
        for n in data:
            done[n] = len(data[n]) if turn == 3 else min(len(data[n]), done[n] + r.randrange(1, 900))  # most often inside a record
            (folder / f"events.out.tfevents.{n}").write_bytes(data[n][: done[n]])
        got = once(part_bytes=200)
        assert len(got) == len(set(got))
    assert got == sorted((n, "loss", i, i / 4) for n in "ab" for i in range(60))
    assert once() == got


@pytest.mark.parametrize("where", ["length", "message"])
def test_damaged_records(run, where):
    """A damaged length ends the file, a damaged message is left out; both are told once, and the batch reader does the same."""
    folder, once = run
    records = [scalar("x", i, 1.0) for i in range(6)]
    bad = bytearray(records[3])
    bad[9 if where == "length" else 20] ^= 1
    at = sum(map(len, records[:3]))
    (folder / "events.out.tfevents.a").write_bytes(b"".join([*records[:3], bytes(bad), *records[4:]]))
    (folder / "events.out.tfevents.b").write_bytes(records[0])
    (folder / "other.txt").write_bytes(b"not a log")
    good = [0, 1, 2] if where == "length" else [0, 1, 2, 4, 5]
    assert [x[1] for x in runs.scalars((folder / "events.out.tfevents.a").read_bytes())] == good
    want = sorted([("a", "x", i, 1.0) for i in good] + [("b", "x", 0, 1.0), ("a", live_logs.DAMAGED, at, None)], key=str)
    assert sorted(once(), key=str) == want
    assert sorted(once(), key=str) == want
