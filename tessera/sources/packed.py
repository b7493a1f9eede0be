"""Packed shards as a Spark data source of Arrow files: `spark.read.format("packed")` and `df.write.format("packed")`.

A root has a folder for each shard (shard-000, shard-001 ...) with Arrow stream files of (input_ids, labels, attention_mask), and two JSON files that make the shard count:
dataset_info.json and state.json, which lists the files in the order of their blocks. This is the layout that loaders of Arrow datasets read.

Writing: tasks put their files into a folder of the job; the commit, given all tasks' messages, moves them into the shards' folders and writes the two JSON files, state.json last. A
job that fails or is stopped leaves no shard that counts, and its folder is removed. A retried or speculative task has files of its own, and only the committed
attempt's are moved. Reading: one partition for each file; filters on shard_id choose the folders and column selection the columns before a file is opened.

Options: path; for reading strict ("true": an incomplete shard is an error; "false": it is passed over), limit (the first shards only); for writing partition and
block_size (kept as metadata), rows_per_file. Rows to be written have shard_id, block_id and the three arrays, sorted by shard_id and block_id in each task, as `write_packed`
leaves them; mode "append" adds shards and never touches one that is there.

Files are opened by pyarrow's file systems, on executors: the path must be one that they reach (a shared folder, hdfs:// with its client, s3://).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "shard_id int, block_id long, input_ids array<int>, labels array<int>, attention_mask array<tinyint>"
COLUMNS = [("input_ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int8()))]
#: The files that make a shard count.
INFO, STATE = "dataset_info.json", "state.json"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") and not path.startswith("file:") else re.sub(r"^file:/+", "file:///", path))


def _name(shard: int) -> str:
    return f"shard-{shard:03d}"


def listed(path: str) -> dict[int, bool]:
    """Shards of a root and whether they are complete; the listing has an entry for each shard."""
    fs, root = _opened(path)
    found = {}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and (m := re.fullmatch(r"shard-(\d+)", f.base_name)):
            found[int(m[1])] = all(x.type == pafs.FileType.File for x in fs.get_file_info([f"{f.path}/{INFO}", f"{f.path}/{STATE}"]))
    return dict(sorted(found.items()))


@dataclass
class _File(InputPartition):
    shard: int
    first: int
    name: str

    def __init__(self, shard: int, first: int, name: str):
        super().__init__((shard, first, name))
        self.shard, self.first, self.name = shard, first, name


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.strict, self.limit = options.get("strict", "true").lower() != "false", options.get("limit")
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Filters on the shard are kept here; Spark applies the others."""
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("shard_id",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, shard: int) -> bool:
        ops = {"==": lambda v: shard == v, ">": lambda v: shard > v, ">=": lambda v: shard >= v, "<": lambda v: shard < v, "<=": lambda v: shard <= v, "in": lambda v: shard in v}
        return all(v is not None and ops[op](v) for op, v in self.tests)

    def partitions(self) -> list[_File]:
        found = listed(self.path)
        if self.strict and (bad := [i for i, ok in found.items() if not ok]):
            raise ValueError(f"incomplete shards: {bad}")
        good = [i for i, ok in found.items() if ok]
        if not good:
            raise ValueError(f"no complete shards in {self.path}")
        fs, root = _opened(self.path)
        out = []
        for shard in filter(self._wanted, good[: int(self.limit)] if self.limit else good):
            with fs.open_input_file(f"{root}/{_name(shard)}/{STATE}") as f:
                for x in json.loads(f.read())["_data_files"]:
                    out.append(_File(shard, x.get("first_block", 0), x["filename"]))
        return out or [_File(-1, 0, "")]

    def read(self, partition: _File):
        if partition.shard < 0:
            return
        fs, root = _opened(self.path)
        at = partition.first
        with fs.open_input_file(f"{root}/{_name(partition.shard)}/{partition.name}") as f, pa.ipc.open_stream(f) as stream:
            for b in stream:
                n = b.num_rows
                own = {"shard_id": lambda n=n: pa.array([partition.shard] * n, pa.int32()), "block_id": lambda n=n, at=at: pa.array(range(at, at + n), pa.int64())}
                yield pa.RecordBatch.from_arrays([own[c]() if c in own else b.column(c) for c in self.names], self.names)
                at += n


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, int, int, str]] = field(default_factory=list)  # shard, first block, blocks, name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = f"_job-{uuid.uuid4().hex}"
        self.rows = int(options.get("rows_per_file", 50_000))
        self.meta = {k: options[k] for k in ("partition", "block_size") if k in options}

    def write(self, batches) -> _Written:
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        done = _Written()
        schema, state = pa.schema(COLUMNS), {"out": None}

        def close():
            if state["out"]:
                state["writer"].close()
                state["out"].close()
                done.files.append((state["shard"], state["first"], state["n"], state["name"]))
                state["out"] = None

        for b in batches:
            shards, blocks = b.column("shard_id").to_pylist(), b.column("block_id").to_pylist()
            lo = 0
            while lo < b.num_rows:
                hi = lo + 1
                while hi < b.num_rows and shards[hi] == shards[lo] and blocks[hi] == blocks[hi - 1] + 1:
                    hi += 1
                if not state["out"] or state["shard"] != shards[lo] or state["first"] + state["n"] != blocks[lo] or state["n"] >= self.rows:
                    close()
                    name = f"{uuid.uuid4().hex}.arrow"
                    out = fs.open_output_stream(f"{root}/{self.job}/{name}")
                    state.update(out=out, writer=pa.ipc.new_stream(out, schema), shard=shards[lo], first=blocks[lo], n=0, name=name)
                hi = min(hi, lo + self.rows - state["n"])
                part = pa.Table.from_batches([b.slice(lo, hi - lo)]).select([c for c, _ in COLUMNS]).cast(schema)
                state["writer"].write_table(part)
                state["n"] += hi - lo
                lo = hi
        close()
        return done

    def commit(self, messages) -> None:
        fs, root = _opened(self.path)
        shards: dict[int, list] = {}
        for m in messages:
            for f in m.files if m else ():
                shards.setdefault(f[0], []).append(f[1:])
        there = listed(self.path)
        if clash := sorted(set(shards) & set(there)):
            self.abort(messages)
            raise ValueError(f"shards are there already: {clash}")
        for shard, files in sorted(shards.items()):
            files.sort()
            gaps = [f for f, g in zip(files[1:], files, strict=False) if f[0] != g[0] + g[1]]
            if gaps or files[0][0] != 0:
                self.abort(messages)
                raise ValueError(f"{_name(shard)}: blocks are not numbered from 0 without gaps")
        for shard, files in sorted(shards.items()):
            own = f"{root}/{_name(shard)}"
            fs.create_dir(own)
            named = []
            for k, (first, n, name) in enumerate(files):
                new = f"data-{k:05d}-of-{len(files):05d}.arrow"
                fs.move(f"{root}/{self.job}/{name}", f"{own}/{new}")
                named.append({"filename": new, "first_block": first, "rows": n})
            kind = {"input_ids": "int32", "labels": "int32", "attention_mask": "int8"}
            info = {"features": {c: {"feature": {"dtype": t, "_type": "Value"}, "_type": "Sequence"} for c, t in kind.items()}, "num_rows": sum(n for _, n, _ in files)} | self.meta
            state = {"_data_files": named, "_fingerprint": uuid.uuid5(uuid.NAMESPACE_URL, f"{self.job}/{shard}").hex[:16], "_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None}
            for name, x in ((INFO, info), (STATE, state)):  # the state last: it makes the shard count
                with fs.open_output_stream(f"{own}/{name}") as f:
                    f.write(json.dumps(x, sort_keys=True).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        """Remove the job's folder; what was moved out of it stays."""
        fs, root = _opened(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class PackedShards(DataSource):
    """The source's registration: spark.dataSource.register(PackedShards)."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("packed shards are only added, never overwritten")
        missing = {"shard_id", "block_id", *(c for c, _ in COLUMNS)} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedShards)


def write_packed(blocks: DataFrame, path: str, partition: str = "train", block_size: int | None = None, rows_per_file: int = 50_000) -> None:
    """Adds the shards of (shard_id, block_id, input_ids, labels, attention_mask) to a root; all in one job, dealt by ranges of blocks."""
    register(blocks.sparkSession)
    dealt = blocks.selectExpr("cast(shard_id as int) shard_id", "cast(block_id as bigint) block_id", "input_ids", "labels", "cast(attention_mask as array<tinyint>) attention_mask")
    out = dealt.repartitionByRange("shard_id", "block_id").sortWithinPartitions("shard_id", "block_id").write.format("packed").mode("append").option("partition", partition).option("rows_per_file", rows_per_file)
    (out.option("block_size", block_size) if block_size else out).save(path)


def read_packed(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """(shard_id, block_id, input_ids, labels, attention_mask) of the complete shards of a root."""
    register(spark)
    out = spark.read.format("packed").option("strict", str(strict).lower())
    return (out.option("limit", limit) if limit else out).load(path)


def drop_incomplete_packed(path: str) -> list[int]:
    """Removes the folders of shards that do not count; returns their ids."""
    fs, root = _opened(path)
    bad = [i for i, ok in listed(path).items() if not ok]
    for i in bad:
        fs.delete_dir(f"{root}/{_name(i)}")
    return bad
