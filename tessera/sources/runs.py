"""Files that training runs leave: checkpoint folders with their metadata, and event logs of scalars."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The files that make a folder a model, and those that describe it.
CONFIG, WEIGHTS = "config.json", ("model.safetensors", "pytorch_model.bin")
LOSS, STATE, SUMMARY = ".eval_loss", "trainer_state.json", "run_summary.json"
SCHEMA = "name string, path string, eval_loss double, eval_loss_raw string, global_step long, epoch double, finished_at string"


class _Folder:
    """A folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.names = {s.getPath().getName(): s for s in self.fs.listStatus(self.path)} if self.fs.exists(self.path) else {}

    def is_model(self) -> bool:
        return CONFIG in self.names and any(w in self.names for w in WEIGHTS)

    def folders(self) -> list[str]:
        return [s.getPath().toString() for s in self.names.values() if s.isDirectory()]

    def text(self, name: str) -> str | None:
        """A small file; Spark's readers pass over names that begin with a dot."""
        if name not in self.names:
            return None
        stream = self.fs.open(self.names[name].getPath())
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()


def _described(folder: _Folder) -> tuple:
    loss, raw = None, folder.text(LOSS)
    if raw is not None:
        try:
            loss, raw = float(raw.strip()), None
        except ValueError:
            raw = raw.strip()
    state, summary = (json.loads(folder.text(f) or "{}") for f in (STATE, SUMMARY))
    # the trainer's state comes first, even where its step is null
    step = state.get("global_step") if STATE in folder.names else summary.get("global_step")
    epoch = state.get("epoch")
    at = folder.path
    return at.getName(), at.toString(), loss, raw, step, None if epoch is None else float(epoch), summary.get("finished_at")


def discovered_checkpoints(spark: SparkSession, root: str, with_root: bool = True, contains: str | None = None, root_name: str = "final") -> DataFrame:
    """(name, path, eval_loss, eval_loss_raw, global_step, epoch, finished_at, key) of root, if it is a model, and of its folders that are models, in the order of their keys.

    The listing is the driver's: a folder for each checkpoint.
    """
    from tessera.functions.text import checkpoint_key

    top = _Folder(spark, root)
    found = [top] if with_root and top.is_model() else []
    found += [f for f in (_Folder(spark, p) for p in top.folders()) if f.is_model()]
    rows = [r for r in map(_described, found) if not contains or contains in r[0]]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumn("key", checkpoint_key("name", root_name)).orderBy("key")


# --- event logs: records of length, checksum, message, checksum; messages in the protocol-buffer wire format ---------------


def _fields(data: bytes):
    """(number, value) of a message: integers, or bytes of fixed or given length."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


def _scalar(value: bytes):
    """(tag, number) of a summary value: a simple value, or a tensor of one float."""
    tag, number = None, None
    for k, v in _fields(value):
        if k == 1:
            tag = v.decode("utf-8", "replace")
        elif k == 2:
            number = struct.unpack("<f", v)[0]
        elif k == 8:
            for k2, v2 in _fields(v):
                if k2 == 4 and len(v2) == 4 or k2 == 5 and len(v2) >= 4:
                    number = struct.unpack("<f", v2[:4])[0]
                elif k2 == 4 and len(v2) == 8 or k2 == 6 and len(v2) >= 8:
                    number = struct.unpack("<d", v2[:8])[0]
    return tag, number


def _table() -> list[int]:
    """Remainders of single bytes by the reflected polynomial of CRC-32C."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0x82F63B78 if byte & 1 else 0)
        out.append(byte)
    return out


TABLE = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    """The checksum as records hold it: rotated by 15 bits and shifted by a constant."""
    crc = crc32c(data)
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def record(message: bytes) -> bytes:
    """A record of a message, for writers and tests."""
    head = struct.pack("<Q", len(message))
    return head + struct.pack("<I", masked(head)) + message + struct.pack("<I", masked(message))


def scalars(data: bytes, check: bool = True):
    """(tag, step, wall time, value) of each scalar of a log, in its order.

    A record that is cut off, or whose length's checksum does not agree, ends it; a message whose checksum does not agree is left out.
    """
    at = 0
    while at + 12 <= len(data):
        size = struct.unpack_from("<Q", data, at)[0]
        if at + 16 + size > len(data) or check and struct.unpack_from("<I", data, at + 8)[0] != masked(data[at : at + 8]):
            return
        if check and struct.unpack_from("<I", data, at + 12 + size)[0] != masked(data[at + 12 : at + 12 + size]):
            at += 16 + size
            continue
        step, time, summary = 0, 0.0, []
        for k, v in _fields(data[at + 12 : at + 12 + size]):
            if k == 1:
                time = struct.unpack("<d", v)[0]
            elif k == 2:
                step = v - (1 << 64) if v >> 63 else v
            elif k == 5:
                summary += [x for n, x in _fields(v) if n == 1]
        for s in summary:
            tag, value = _scalar(s)
            if tag is not None and value is not None:
                yield tag, step, time, value
        at += 16 + size


def event_logs(spark: SparkSession, folder: str, pattern: str = "events.out.tfevents.*") -> DataFrame:
    """(file, tag, step, wall_time, value) of the scalars of all logs of a folder, a task for some of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path.rsplit("/", 1)[-1], *x) for x in scalars(content)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "tag", "step", "wall_time", "value"])

    return files.mapInArrow(run, "file string, tag string, step long, wall_time double, value double")


def merged_event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, step, value): of a step that several logs have, the last one's in the order of names and times."""
    from pyspark.sql import functions as F

    return event_logs(spark, folder).groupBy("tag", "step").agg(F.max_by("value", F.struct("file", "wall_time")).alias("value"))
