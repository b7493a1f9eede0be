"""What the operators of this package share: written cuts of the lineage and numpy text primitives.

The numpy part works on the bytes of an Arrow string column directly, without making Python strings.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in single-machine mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Spark removes the shuffle files of a query when the query ends, instead of when the driver happens to collect garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, *used) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, its shuffle files go, and it survives lost executors. used, and what holds() named: broadcasts and cuts that only df reads; they are released."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    for x in (*used, *getattr(df, "_tessera_used", ())):
        drop_cut(x) if isinstance(x, DataFrame) else x.destroy()
    return out


@contextmanager
def small_batches(spark: SparkSession, most: int):
    """Queries that run meanwhile hand Arrow batches of about so many bytes to Python at most; each task holds one on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def holds(df: DataFrame, *used) -> DataFrame:
    """df, which alone reads these broadcasts and cuts (and those of DataFrames among them): cut() releases them once df is written."""
    df._tessera_used = [y for x in used for y in (x, *getattr(x, "_tessera_used", ()))]
    return df


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and their heaps would only grow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, for mapInArrow, that leaves the worker small when it ends."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length n + 1, from 0) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(kind)
    if col.null_count:
        col = pc.fill_null(col, b"" if kind == pa.large_binary() else "")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(offs: np.ndarray, limit: int = 300_000):
    """Row ranges whose texts together have at most limit bytes (a longer text stands alone)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def class_table(excluded: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_SPACE = class_table(SPACE)
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER = np.frombuffer(LOWER_BYTES, np.uint8)


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (maximal runs of table's bytes in one row) and each row's first word index."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    # 1 where a word goes on from the byte before; a row's first byte never does
    m = np.empty(n + 2, bool)
    m[0] = m[-1] = False
    m[1:-1] = table[data]
    edges = np.unique(offs[1:-1])
    edges = edges[(edges > 0) & (edges < n)]
    turn = m[1:] != m[:-1]
    whole = edges[m[edges] & m[edges + 1]]
    del m
    places = np.flatnonzero(turn)
    if len(whole):
        places = np.sort(np.concatenate((places, whole, whole)))
    starts, ends = places[::2], places[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))  # a new array, which the rest changes in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes or words that are hashed at once.
PIECE = 1 << 18


class Rolling:
    """Polynomial hashes modulo 2**64 of arbitrary spans, from one prefix sum and inverse powers of an odd base."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.salt = np.uint64(int(rng.integers(0, 1 << 62)))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base, np.uint64), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _prefix(self, x: np.ndarray) -> np.ndarray:
        self._powers(len(x) + 1)
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=c[1:])
        return c

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each byte span; starts ascend and spans do not overlap. Long data goes by pieces, so that memory follows the spans and not the bytes."""
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            begin = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
            s, e = starts[lo:hi] - begin, ends[lo:hi] - begin
            if e[-1] > PIECE:  # one span longer than a piece
                out[lo] = self._long(data[begin : begin + int(e[-1])])
            else:
                c = self._prefix(self.table[data[begin : begin + int(e[-1])]])
                out[lo:hi] = (c[e] - c[s]) * self.down[s]
            lo = hi
        return mix(out + (ends - starts).astype(np.uint64) * self.salt)

    def _long(self, data: np.ndarray) -> np.uint64:
        self._powers(PIECE + 1)
        total, up = 0, 1
        for i in range(0, len(data), PIECE):
            part = data[i : i + PIECE]
            total += int((self.table[part] * self.up[: len(part)]).sum(dtype=np.uint64)) * up
            up = up * pow(self.base, PIECE, 1 << 64) & M64
        return np.uint64(total & M64)

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """One hash for each k consecutive word hashes, across row borders too."""
        if len(words) < k:
            return np.zeros(0, np.uint64)
        out = np.empty(len(words) - k + 1, np.uint64)
        for lo in range(0, len(out), PIECE):
            n = min(PIECE, len(out) - lo)
            c = self._prefix(mix(words[lo : lo + n + k - 1] + self.salt))
            out[lo : lo + n] = mix((c[k:] - c[:n]) * self.down[:n])
        return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(h) < w:
        return np.zeros(0, h.dtype)
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = w - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


#: A table of at most so many bytes is dealt to all cores if its files split into fewer parts.
SMALL = 128 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as its files split; a small one (SMALL) that splits into fewer parts than there are cores is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    if table in ("documents", "pages"):
        plan = df._jdf.queryExecution()
        if int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SMALL and plan.toRdd().getNumPartitions() < cores:
            return df.repartition(cores)
    return df


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, least: int = 200_000) -> DataFrame:
    """left.join(right, key) where right has one row for each key and in `count` how many rows of left have it.

    Keys of more than `least` rows and of a 20,000th of all (so 20,000 keys at most) are broadcast instead of shuffled, so that the rows
    of a hot key stay where they are.
    """
    limit = max(least, total // 20_000)
    if total <= limit:
        return left.join(right, key)
    hot = right.where(F.col(count) > limit)
    if not hot.take(1):
        return left.join(right, key)
    few = F.broadcast(hot)  # total / limit rows at most
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(right, key))


def excerpt(text: Column, most_bytes: int, pieces: int = 64) -> Column:
    """text, or of one of more bytes so many pieces at even places of the whole, joined by spaces: for samples that must be bounded."""
    step = max(most_bytes // pieces // 4, 1)
    part = lambda i: F.substring(text, F.floor(i * (F.length(text) - step) / (pieces - 1)).cast("int") + 1, F.lit(step))
    return F.when(text.isNull() | (F.octet_length(text) <= most_bytes), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), part), " "))


def fitting(sizes: list[tuple], most: int, each: int) -> list:
    """Keys of (key, bytes) in their order whose excerpts of `each` bytes at most stay within `most` together; what does not fit is left out singly, and the first always fits."""
    out, total = [], 0
    for key, size in sizes:
        size = min(size or 0, each)
        if total + size <= most:
            total += size
            out.append(key)
    return out


class Forest:
    """Union-find over arbitrary hashable nodes, for one bounded bucket."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
