"""Benchmark decontamination by winnowing.

Test items and training texts keep the minimum k-word hash of each window of `span - k + 1` shingles, so every shared span of
`span` words has a kept fingerprint in common. Fingerprints are joined, and each hit is extended to both sides by whole words;
hits that reach `span` words mark the document's words. Items of fewer words than `span` are one window of their own length and
keep every shingle of that length.

The benchmark is indexed in blocks of at most `block_bytes` of text, each once on the driver (about 7 bytes a byte of text), and goes to the tasks as
arrays: usually one block; a larger benchmark takes several passes whose hits are merged, so nothing unbounded is broadcast.

Defined results: null texts have no words and null items no windows; an item without words never occurs; equal items all
count; a null doc_id gets its own row; a null item_id never counts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, Rolling, class_table, cover, holds, lean, slices, sliding_min, string_buffers, word_spans

WORD = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _texts(col: pa.Array):
    """(lower-cased bytes, offsets, word starts, ends, first words) for slices of a column."""
    raw, offs = string_buffers(col)
    for lo, hi in slices(offs):
        part, at = LOWER[raw[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        yield lo, hi, part, *word_spans(part, at, WORD)


def _winnow(h: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Places that hold the (rightmost) minimum of a valid window of w hashes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = sliding_min(h, w)
    take = np.zeros(len(h), bool)
    todo = np.asarray(valid[:n])
    for o in range(w - 1, -1, -1):
        at = todo & (h[o : o + n] == low)
        take[o : o + n] |= at
        todo = todo & ~at
    return np.flatnonzero(take)


class Index:
    """Fingerprints of one block of test items."""

    def __init__(self, items: list[tuple[int, str]], span: int, k: int):
        self.span, self.k, self.byte, self.roll = span, k, Rolling(21), Rolling(22)
        self.ids = [i for i, _ in items]
        words, self.begin, self.end = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        fps, places = [], []
        base = 0
        for number, (_, text) in enumerate(items):
            for _, _, part, s, e, _ in _texts(pa.array([text], pa.string())):
                w = self.byte.spans(part, s, e)
                n = len(w)
                if 0 < n < span:
                    short.setdefault(n, []).append((int(self.roll.grams(w, n)[0]), number))
                elif n:
                    h = self.roll.grams(w, k)
                    at = _winnow(h, span - k + 1, np.ones(len(h), bool))
                    fps.append(h[at])
                    places.append(np.stack([at + base, np.full(len(at), number)], 1))
                    words.append(w)
                    self.begin.append(np.full(n, base))
                    self.end.append(np.full(n, base + n))
                    base += n
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.words, self.begin, self.end = join(words, np.uint64), join(self.begin, np.int64), join(self.end, np.int64)
        fps = join(fps, np.uint64)
        places = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
        order = np.argsort(fps, kind="stable")
        self.fps, self.places = fps[order], places[order]
        self.short = {}
        for n, x in short.items():
            x.sort()
            self.short[n] = (np.array([h for h, _ in x], np.uint64), np.array([i for _, i in x], np.int64))
        self.filter = {0: self._filter(self.fps)} | {n: self._filter(h) for n, (h, _) in self.short.items()}
        self.byte, self.roll = Rolling(21), Rolling(22)  # without the tables of powers that they have made

    @staticmethod
    def _filter(h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 18, bool)
        bits[(h >> np.uint64(46)).astype(np.int64)] = True
        return bits

    def _pairs(self, h: np.ndarray, at: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For places `at` with hashes h: (place, row of keys) for each equal key."""
        may = self.filter[n][(h >> np.uint64(46)).astype(np.int64)]
        h, at = h[may], at[may]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        count = hi - lo
        rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), rows

    def hits(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item number) of the spans of words that occur in items; doc: each word's row, first: rows' first words."""
        found = []
        k, more = self.k, self.span - self.k
        n = len(words)
        if len(self.fps) and n >= self.span:
            h = self.roll.grams(words, k)
            left = first[doc + 1][: n - self.span + 1] - np.arange(n - self.span + 1)
            at = _winnow(h, more + 1, left >= self.span)
            p, row = self._pairs(h[at], at, self.fps, 0)
            q, item = self.places[row, 0], self.places[row, 1]
            good = np.ones(len(p), bool)
            for j in range(k):
                good &= words[p + j] == self.words[q + j]
            p, q, item = p[good], q[good], item[good]
            reach = []
            for step, edge, own in ((-1, self.begin[q], first[doc[p]]), (1, self.end[q] - 1, first[doc[p] + 1] - 1)):
                x, y = p + (k - 1) * (step > 0), q + (k - 1) * (step > 0)
                length, going = np.zeros(len(p), np.int64), np.ones(len(p), bool)
                for _ in range(more):
                    x, y = x + step, y + step
                    inside = ((own - x) * step >= 0) & ((edge - y) * step >= 0)
                    going &= inside
                    going[going] = words[x[going]] == self.words[y[going]]
                    length += going
                reach.append(length)
            good = reach[0] + reach[1] >= more
            found.append(((p - reach[0])[good], (p + k + reach[1])[good], item[good]))
        for size, (keys, items) in self.short.items():
            if n >= size:
                h = self.roll.grams(words, size)
                at = np.flatnonzero(first[doc + 1][: len(h)] - np.arange(len(h)) >= size)
                p, row = self._pairs(h[at], at, keys, size)
                found.append((p, p + size, items[row]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(bench: DataFrame, block_bytes: int, id_col: str, text_col: str):
    """Lists of (item_id, text), each of about block_bytes at most."""
    items = bench.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = -(-int(total) // block_bytes) or 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in part.collect()], n


def scan(docs: DataFrame, bench: DataFrame, span: int = 10, k: int = 6, block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hit_words: number of words in shared windows, items: sorted ids of the items with shared windows)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(named.dtypes)["doc_id"]
    sc = docs.sparkSession.sparkContext

    def one(items, spans: bool):
        shared = sc.broadcast(Index(items, span, k))  # of block_bytes of text at most

        def run(batches):
            index = shared.value
            for b in batches:
                total, hit, ids, firsts, lasts = [], [], [], [], []
                for lo, hi, part, s, e, first in _texts(b.column(1)):
                    words = index.byte.spans(part, s, e)
                    doc = np.repeat(np.arange(hi - lo), np.diff(first))
                    begin, end, item = index.hits(words, doc, first)
                    hit_words = np.concatenate(([0], np.cumsum(cover(begin, end, len(words)))))
                    total.append(np.diff(first))
                    hit.append(hit_words[first[1:]] - hit_words[first[:-1]])
                    by: dict = {}
                    for d, i in np.unique(np.stack([doc[begin], item], 1), axis=0).tolist() if len(begin) else ():
                        by.setdefault(d, set()).add(index.ids[i])
                    ids += [sorted(by.get(d, ())) for d in range(hi - lo)]
                    if spans:
                        at: dict = {}
                        for d, x, y in zip(doc[begin].tolist(), begin.tolist(), end.tolist(), strict=True):
                            at.setdefault(d, set()).add((x - int(first[d]), y - int(first[d])))
                        firsts += [[x for x, _ in sorted(at.get(d, ()))] for d in range(hi - lo)]
                        lasts += [[y for _, y in sorted(at.get(d, ()))] for d in range(hi - lo)]
                if not total:
                    continue
                cols = [b.column(0), pa.array(np.concatenate(total)), pa.array(np.concatenate(hit)), pa.array(ids, pa.list_(pa.string()))]
                names = ["doc_id", "n_words", "hit_words", "items"]
                if spans:
                    cols += [pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))]
                    names += ["firsts", "lasts"]
                yield pa.RecordBatch.from_arrays(cols, names)

        return run

    out = f"doc_id {kind}, n_words long, hit_words long, items array<string>"
    passes = []
    keyed = None
    for items, n in _blocks(bench, block_bytes, item_col, item_text_col):
        if n == 1:
            return named.mapInArrow(lean(one(items, False)), out)
        # several blocks: rows are numbered by content, so that each row's hits meet again
        if keyed is None:
            keyed = named.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l")).alias("doc_id"), "text")
        passes.append(keyed.mapInArrow(lean(one(items, True)), f"doc_id struct<doc_id: {kind}, h: bigint, l: int>, n_words long, hit_words long, items array<string>, firsts array<int>, lasts array<int>"))
    every = passes[0]
    for p in passes[1:]:
        every = every.union(p)
    n = len(passes)
    marked = F.flatten(F.collect_list(F.flatten(F.transform(F.arrays_zip("firsts", "lasts"), lambda x: F.sequence(x["firsts"], x["lasts"] - 1)))))
    merged = every.groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"), F.size(F.array_distinct(marked)).cast("long").alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows")
    )
    copies = F.explode(F.sequence(F.lit(1), (F.col("rows") / n).cast("int")))
    return merged.select("doc_id.doc_id", "n_words", "hit_words", "items", copies.alias("copy")).drop("copy")


def clean(docs: DataFrame, bench: DataFrame, span: int = 10, k: int = 6, block_bytes: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """docs without the documents that share a window with a test item; each block is one pass that filters the rows."""
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    place, used = columns.index(text_col), []
    for items, _ in _blocks(bench, block_bytes, "item_id", "text"):
        shared = sc.broadcast(Index(items, span, k))  # of block_bytes of text at most
        used.append(shared)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, hi, part, s, e, first in _texts(b.column(place)):
                    doc = np.repeat(np.arange(hi - lo), np.diff(first))
                    begin, _, _ = index.hits(index.byte.spans(part, s, e), doc, first)
                    keep[lo + doc[begin]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return holds(docs, *used)
