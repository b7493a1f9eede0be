"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if their balls of radius r share a member, so every fingerprint
emits all variants within half the radius and fingerprints that share a variant are linked (both lie within r of it:
the triangle inequality verifies the pair). The variants travel in factored form: the shuffle carries the variants'
distinct first `prefix` bits (for 64 bits and r = 2: 137 prefixes of 16 bits stand for the 2,081 variants) and
the receiver enumerates the remaining bits of exactly those variants. A bucket yields a spanning forest, not its pairs.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; a null doc_id gets the
component of its fingerprint, and null if no document with an id is there; exact copies collapse to one fingerprint
before any bucket is built; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near_docs
from tessera.llm.components import connected
from tessera.llm.shared import LOWER_BYTES, Forest, cut, hot_join, lean, mix


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles (repeats included): a bit is set if it is set in over half of the hashes."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-k])).tolist()
    cuts = map(joined.__getitem__, map(slice, starts, (ends[k - 1 :] - 1).tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: long with the fingerprint's 64 bits)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(None if t is None else t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """For 0..most: the masks of up to so many of the low `bits` bits."""
    one = [1 << i for i in range(bits)]
    by = [[0], one, [a | b for i, a in enumerate(one) for b in one[:i]]]
    return [np.array([m for x in by[: r + 1] for m in x], np.uint64) for r in range(most + 1)]


def ball_links(fps: DataFrame, prefix: int = 16, room: int = 4_000_000, buckets: int = 4096) -> DataFrame:
    """fps(fp: distinct longs) -> (a, b): links that connect all fingerprints within 4 bits of each other.

    prefix: bits of a variant that the shuffle is keyed on, by their hash in so many buckets. room: variants that a task enumerates at once; a larger bucket
    is enumerated in rounds by a residue of the variant, so memory stays bounded.
    """
    low = 64 - prefix

    def send(batches):
        near = _flips(prefix, 2)[2]
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 8192):
                part = fp[i : i + 8192]
                key = (part[:, None] >> np.uint64(low)) ^ near[None, :]
                out = np.empty((key.size, 2), np.uint64)
                out[:, 0] = key.ravel()
                out[:, 1] = np.repeat(part, len(near))
                bucket = mix(out[:, 0] + np.uint64(1)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, out = bucket[order], out[order]
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                # an entry: the prefix's low bits, then the fingerprint
                cells = np.empty((len(out), 12), np.uint8)
                cells[:, :4] = out[:, 0].astype("<u4").view(np.uint8).reshape(-1, 4)
                cells[:, 4:] = out[:, 1].astype("<u8").view(np.uint8).reshape(-1, 8)
                offs = np.append(at, len(out)).astype(np.int64) * 12
                load = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(cells.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), load.cast(pa.binary())], ["bucket", "load"])

    def meet(table: pa.Table) -> pa.Table:
        raw = b"".join(x for c in table.column("load").chunks for x in c.to_pylist())
        cells = np.frombuffer(raw, np.uint8).reshape(-1, 12)
        key = np.ascontiguousarray(cells[:, :4]).view("<u4").ravel().astype(np.uint64)
        fp = np.ascontiguousarray(cells[:, 4:]).view("<u8").ravel()
        left = 2 - np.bitwise_count(key ^ (fp >> np.uint64(low))).astype(np.int64)
        rest = fp & np.uint64((1 << low) - 1)
        masks = _flips(low, 2)
        total = int(sum((left == r).sum() * len(masks[r]) for r in range(3)))
        rounds = max(1, math.ceil(total / room))
        forest, a, b = Forest(), [], []
        for turn in range(rounds):
            var, who = [], []
            for r in range(3):
                own = np.flatnonzero(left == r)
                step = max(1, room // len(masks[r]))
                for i in range(0, len(own), step):
                    o = own[i : i + step]
                    v = (rest[o, None] ^ masks[r][None, :]).ravel()
                    w = np.repeat(o, len(masks[r]))
                    v |= key[w] << np.uint64(low)
                    if rounds > 1:
                        keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(rounds) == turn
                        v, w = v[keep], w[keep]
                    var.append(v)
                    who.append(w)
            v, w = np.concatenate(var), np.concatenate(who)
            order = np.argsort(v, kind="stable")
            v, w = v[order], w[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            x, y = fp[w[same]], fp[w[same + 1]]
            x, y = np.minimum(x, y), np.maximum(x, y)
            if len(x):
                pairs = np.unique(np.stack([x, y], 1), axis=0)
                for p, q in pairs.tolist():
                    if p != q and forest.join(p, q):
                        a.append(p)
                        b.append(q)
        as_long = lambda z: pa.array(np.array(z, np.uint64).view(np.int64))
        return pa.table({"a": as_long(a), "b": as_long(b)})

    return fps.select("fp").mapInArrow(lean(send), "bucket long, load binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most 4 differing bits."""
    fps = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    prefix = min(28, max(16, math.ceil(math.log2(max(2, n))) - 2))
    entries = n * (1 + prefix + prefix * (prefix - 1) // 2)
    links = cut(ball_links(own, prefix, buckets=1 << min(24, max(12, (entries // 50_000).bit_length()))), "ball-links")
    roots = connected(links)
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(named.join(least, "root").select("fp", "n", "component_id"), "components", links, own)
    return hot_join(fps, by_fp, "fp", "n", total).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """docs with one document of each group whose links have a similarity of least or more of their k-word shingles (see near_docs)."""
    return near_docs.near_dedup(docs, least, k)
