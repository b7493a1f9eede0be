"""Event logs that are still being written, as a streaming source of scalars.

`spark.readStream.format("event_logs").load(folder)` gives (file, tag, step, wall_time, value). The position is a number of bytes for each file, always at the
end of a record, so a trigger reads only what files have grown by since the one before, and a query that is started again goes on inside them. A record whose last
bytes are not there yet is left to a later trigger.

Each record has masked CRC-32C checksums of its length and of its message. Where that of a length does not agree the file ends, as nothing after it can be found: what came before stays, and the file is not
read again. A message that does not agree is left out; its length is sound, so the file goes on. Either is counted by one row with the tag `!damaged`, the place as step and a null value.

A trigger has a partition for each file that has grown, cut into parts of `part_bytes` at ends of records; `max_bytes` bounds what a file gives to a trigger. The folder must be one
that the driver and the executors reach through pyarrow's file systems; the driver lists it and reads record headers alone.
"""

from __future__ import annotations

import fnmatch
import struct

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.runs import masked, scalars

SCHEMA = "file string, tag string, step long, wall_time double, value double"
DAMAGED = "!damaged"


def _ends(f: pa.NativeFile, at: int, most: int, part: int) -> tuple[list[int], int | None]:
    """(places from `at` on at which parts end, place of a damaged header): whole records only, by their headers."""
    size, places, damaged, start = f.size(), [], None, at
    while at + 16 <= size and at - start < most:
        f.seek(at)
        head = f.read(12)
        n = struct.unpack("<Q", head[:8])[0]
        if struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            damaged = at
            break
        if at + 16 + n > size:
            break
        at += 16 + n
        if at - (places[-1] if places else start) >= part:
            places.append(at)
    if at > (places[-1] if places else start):
        places.append(at)
    return places, damaged


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class _LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"])
        self.folder, self.pattern = options["path"], options.get("pattern", "events.out.tfevents.*")
        self.part, self.most = int(options.get("part_bytes", 32 << 20)), int(options.get("max_bytes", 1 << 40))
        self.last: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Bytes of whole records of each file; -1 - place where a file is damaged, which it keeps."""
        out = dict(self.last)
        for f in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)):
            if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and out.get(f.base_name, 0) >= 0:
                begin = out.get(f.base_name, 0)
                with self.fs.open_input_file(f.path) as x:
                    places, damaged = _ends(x, begin, self.most, self.part)
                end = places[-1] if places else begin
                out[f.base_name] = end if damaged is None else -1 - end
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self.last = dict(end)
        out = []
        for name, to in sorted(end.items()):
            begin = start.get(name, 0)
            if to == begin or begin < 0:
                continue
            stop = to if to >= 0 else -1 - to
            with self.fs.open_input_file(f"{self.root}/{name}") as x:
                places = [p for p in _ends(x, begin, stop - begin, self.part)[0] if p <= stop]
            for p in places:
                out.append(_Part(name, begin, p))
                begin = p
            if to < 0:
                out.append(_Part(name, stop, -1))
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part):
        name, begin, end = partition.path, partition.begin, partition.end
        if end < 0:
            yield name, DAMAGED, begin, 0.0, None
            return
        if end <= begin:
            return
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            data = f.read_at(end - begin, begin)
        at = 0
        while at < len(data):
            n = struct.unpack_from("<Q", data, at)[0]
            message = data[at + 12 : at + 12 + n]
            if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(message):
                yield name, DAMAGED, begin + at, 0.0, None
            else:
                for tag, step, time, value in scalars(data[at : at + 16 + n], check=False):
                    yield name, tag, step, time, value
            at += 16 + n

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "fs"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.fs = pafs.FileSystem.from_uri(self.folder)[0]


class EventLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802
        return _LogReader(self.options)


def live_event_logs(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(file, tag, step, wall_time, value) of the scalars of a folder's logs, as they are written."""
    spark.dataSource.register(EventLogs)
    return spark.readStream.format("event_logs").options(**options).load(folder)
