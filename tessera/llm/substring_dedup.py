"""Exact substring dedup by seed and extend.

Seeds: every window of `span` words keeps the minimum hash of its k-word shingles (winnowing), so two occurrences of one
window always keep the same anchor. Documents meet on anchors: one shuffle row stands for a run of consecutive windows that
keep one anchor (about span / 2 windows), and carries their hashes. Extension: within an anchor's group, occurrences extend
to both sides at once, split by split: a window reaching o words left and span - k - o words right of the anchor matches
another occurrence exactly if their hashes agree, so a group of n occurrences costs n * span comparisons, never n * n pairs.
Consecutive matching windows join to maximal repeats, reported as word ranges. A window's identity is 112 bits (the
64-bit anchor and 48 bits of an independent hash).

An anchor of more than `hot` occurrences (as a sample of the documents shows; the sample decides only the way, not the result) is not gathered in a task:
its windows become rows, the smallest document of each window is an aggregate with map-side combining, and a join that leaves hot windows where they
are finds the windows of larger documents.

Defined results: a null or wordless text has 0 words; a null doc_id neither loses words nor covers others; repeats within one
document stay; rows of one doc_id never cover each other, but each row loses what smaller ids have; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import NOT_SPACE, Rolling, cover, cut, hot_join, lean, mix, slices, sliding_min, string_buffers, word_spans

CELL = 6


def _cells(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL]


def window_runs(docs: DataFrame, span: int = 50, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(anchor, doc_id, version: hash of the text, start, windows): for each run of windows of one document with one anchor, the first word and the packed hashes."""

    def run(batches):
        byte_hash, seed_hash, window_hash = Rolling(11), Rolling(12), Rolling(13)
        for b in batches:
            ids, versions = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            raw, offs = string_buffers(b.column(1))
            for lo, hi in slices(offs):
                part, at = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                s, e, first = word_spans(part, at, NOT_SPACE)
                if len(s) < span:
                    continue
                words = byte_hash.spans(part, s, e)
                anchors = sliding_min(seed_hash.grams(words, k), span - k + 1)
                whole = window_hash.grams(words, span)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                w = np.flatnonzero(first[doc + 1][: len(whole)] - np.arange(len(whole)) >= span)
                if not len(w):
                    continue
                a, d = anchors[w], doc[w]
                at = np.flatnonzero(np.concatenate(([True], (np.diff(w) != 1) | (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
                cells = np.ascontiguousarray(_cells(whole[w]))
                load = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(w)).astype(np.int64) * CELL), pa.py_buffer(cells)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[at].view(np.int64)), pa.array(ids[lo + d[at]]), pa.array(versions[lo + d[at]]), pa.array((w[at] - first[d[at]]).astype(np.int32)), load.cast(pa.binary())],
                    ["anchor", "doc_id", "version", "start", "windows"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    return named.where("doc_id is not null and text is not null").mapInArrow(lean(run), "anchor long, doc_id long, version long, start int, windows binary")


def _covered(t: pa.Table, span: int) -> pa.RecordBatch | None:
    """Of whole groups sorted by anchor: the word ranges whose windows also start in a smaller document."""
    t = t.combine_chunks()
    anchor = t.column("anchor").to_numpy()
    same = anchor[1:] == anchor[:-1]
    met = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if not met.any():
        return None
    t = t.filter(pa.array(met)).combine_chunks()
    anchor, doc = t.column("anchor").to_numpy().view(np.uint64), t.column("doc_id").to_numpy()
    raw, offs = string_buffers(t.column("windows"))
    cells = np.zeros((len(raw) // CELL, 8), np.uint8)
    cells[:, :CELL] = raw.reshape(-1, CELL)
    h = cells.view("<u8").ravel()
    row = np.repeat(np.arange(len(doc)), np.diff(offs) // CELL)
    key = mix(anchor)[row] + h * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    key, d = key[order], doc[row[order]]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    least = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    hit = np.zeros(len(d), bool)
    hit[order] = d > least
    at = np.flatnonzero(hit)
    if not len(at):
        return None
    heads = np.concatenate(([True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])))
    tails = np.concatenate((heads[1:], [True]))
    begin, end = at[heads], at[tails]
    of = row[begin]
    start = t.column("start").to_numpy()[of].astype(np.int64) - offs[of] // CELL
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[of]), pa.array(t.column("version").to_numpy()[of]), pa.array((start + begin).astype(np.int32)), pa.array((start + end + span).astype(np.int32))], ["doc_id", "version", "first", "last"]
    )


def hot_anchors(docs: DataFrame, span: int, k: int, id_col: str, text_col: str, hot: int, share: int) -> np.ndarray:
    """Anchors of more than hot occurrences, by the documents whose text's hash is divisible by share; sorted."""
    some = window_runs(docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(share)) == 0), span, k, id_col, text_col)
    least = max(hot // share, 16)
    rows = some.groupBy("anchor").count().where(F.col("count") > least).orderBy(F.desc("count"), "anchor").limit(1 << 20).collect()  # the most frequent 2**20 at most
    return np.sort(np.array([r.anchor for r in rows], np.int64))


def hot_repeats(runs: DataFrame, span: int) -> DataFrame:
    """repeats for the runs of hot anchors, a row for each window."""

    def windows(batches):
        for b in batches:
            raw, offs = string_buffers(b.column(4))
            n = np.diff(offs) // CELL
            cells = np.zeros((len(raw) // CELL, 8), np.uint8)
            cells[:, :CELL] = raw.reshape(-1, CELL)
            row = np.repeat(np.arange(len(n)), n)
            a, d, v, s = (b.column(i).to_numpy(zero_copy_only=False)[row] for i in range(4))
            first = s + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(cells.view("<i8").ravel()), pa.array(d), pa.array(v), pa.array(first.astype(np.int32))], ["anchor", "window", "doc_id", "version", "first"])

    rows = cut(runs.mapInArrow(lean(windows), "anchor long, window long, doc_id long, version long, first int").withColumn("key", F.struct("anchor", "window")), "hot-windows")
    least = cut(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")), "hot-least")
    found = hot_join(rows, least.where("most > least").select("key", "least", "n"), "key", "n", rows.count()).where("doc_id > least")
    return cut(found.select("doc_id", "version", "first", (F.col("first") + span).alias("last")), "hot-repeats", rows, least)


def repeats(docs: DataFrame, span: int = 50, k: int = 16, id_col: str = "doc_id", text_col: str = "text", hold: int = 100_000, hot: int = 50_000, share: int = 16) -> DataFrame:
    """(doc_id, version, first, last): word ranges [first, last) of maximal repeats of span words or more that a smaller document has too, by anchor.

    hold: rows after which a task works off the groups that it has complete.
    """
    many = hot_anchors(docs, span, k, id_col, text_col, hot, share)
    shared = docs.sparkSession.sparkContext.broadcast(many)  # 2**20 anchors at most

    def pick(wanted: bool):
        def run(batches):
            hot_ones = shared.value
            for b in batches:
                a = b.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(hot_ones, a), len(hot_ones) - 1)
                yield b.filter(pa.array((hot_ones[at] == a) == wanted))

        return run

    def extend(batches):
        held, rows, first = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            first = b.column(0)[0].as_py() if first is None else first
            last = b.column(0)[b.num_rows - 1].as_py()
            if rows < hold or first == last:
                continue
            t = pa.concat_tables(held)
            done = int(np.searchsorted(t.column("anchor").to_numpy(), last, "left"))
            out = _covered(t.slice(0, done), span)
            if out is not None:
                yield out
            held, rows, first = [t.slice(done).combine_chunks()], rows - done, last
        if rows:
            out = _covered(pa.concat_tables(held), span)
            if out is not None:
                yield out

    runs = window_runs(docs, span, k, id_col, text_col)
    cold = runs.mapInArrow(lean(pick(False)), runs.schema) if len(many) else runs
    out = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(extend), "doc_id long, version long, first int, last int")
    return out.union(hot_repeats(runs.mapInArrow(lean(pick(True)), runs.schema), span)) if len(many) else out


def dedup(docs: DataFrame, span: int = 50, k: int = 16, id_col: str = "doc_id", text_col: str = "text", hot: int = 50_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept are the words outside repeats, joined by one space."""
    found = repeats(docs, span, k, id_col, text_col, hot=hot).groupBy("doc_id", "version").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("version")).join(found, ["doc_id", "version"], "left")

    def keep(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, first, last in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                total = len(words)
                if first and total:
                    hit = cover(np.minimum(first, total), np.minimum(last, total), total)
                    words = [words[i] for i in np.flatnonzero(~hit)]
                n.append(total)
                gone.append(total - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "firsts", "lasts").mapInArrow(lean(keep), "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))

