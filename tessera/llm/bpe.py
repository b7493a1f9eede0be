"""Byte-level BPE encoding and decoding with segment trees.

Each pre-token has a segment tree whose leaves hold rank * size + place of its adjacent pairs; the root is the leftmost pair
of the lowest rank. A merge updates three leaves and their paths, in logarithmic time, until no mergeable pair is left. The
trees of all new pre-tokens of a slice with the same size advance together as numpy columns. A bounded memo keeps pre-tokens.

Defined results: a null text has no tokens and decodes to the empty text; the vocabulary's special strings in a text become their
own ids, as in the tokenizers library; bytes that are no UTF-8 after decoding become U+FFFD; a null id stays null.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, slices, string_buffers

#: Fixed value: the public pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 62)
KEY = 1 << 20


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge table and token bytes of a tokenizers JSON file (byte-level BPE without normalizer, dropout or prefix space)."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, back = data["model"], byte_chars()
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * KEY + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], NONE), np.append(order, 0).astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks: dict[int, int] | None = None

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; a negative id is no symbol."""
        key = np.where((a < 0) | (b < 0), -1, a * KEY + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of equally sized pre-tokens (lens within one power of two): flat ids and the number of each."""
        n, size = len(starts), 1 << max(0, int(lens.max() - 1).bit_length())
        place = np.arange(size)
        inside = place[None, :] < lens[:, None]
        sym = np.full((n, size + 1), -1, np.int64)
        sym[:, :size][inside] = self.byte_id[data[(starts[:, None] + place[None, :])[inside]]]
        after = np.where(place[None, :] + 1 < lens[:, None], place[None, :] + 1, size)
        after = np.concatenate((after, np.full((n, 1), size)), 1)
        before = np.concatenate((np.where(place[None, :] == 0, size, place[None, :] - 1).repeat(n, 0), np.full((n, 1), size)), 1)
        tree = np.full((n, 2 * size), NONE)
        rank = self.pair_rank(sym[:, :size], np.take_along_axis(sym, after[:, :size], 1))
        tree[:, size:] = np.where(rank < NONE, rank * size + place[None, :], NONE)
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        depth = size.bit_length() - 1
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            p = root % size
            q = after[rows, p]
            r = after[rows, q]
            left = before[rows, p]
            sym[rows, p] = self.merged[root // size]
            sym[rows, q] = -1
            after[rows, p] = r
            before[rows, r] = p
            new = self.pair_rank(sym[rows, p], sym[rows, r])
            old = self.pair_rank(sym[rows, left], sym[rows, p])
            tree[rows, size + q] = NONE
            tree[rows, size + p] = np.where(new < NONE, new * size + p, NONE)
            some = left < size
            tree[rows[some], size + left[some]] = np.where(old < NONE, old * size + left, NONE)[some]
            for leaf in (p, q, np.where(some, left, p)):
                node = (size + leaf) >> 1
                for _ in range(depth):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            rows = rows[tree[rows, 1] < NONE]
        alive = sym[:, :size] >= 0
        return sym[:, :size][alive], alive.sum(1)

    def merge_one(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long pre-token: the same segment tree in plain integers, where columns of one row would cost more than they save."""
        if self.ranks is None:
            self.ranks = dict(zip(self.keys[:-1].tolist(), self.rank[:-1].tolist(), strict=True))
        ranks, merged, none = self.ranks, self.merged, int(NONE)
        n = len(data)
        size = 1 << max(0, (n - 1).bit_length())
        sym = self.byte_id[data].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [none] * (2 * size)

        def leaf(p: int) -> int:
            q = after[p]
            r = none if q < 0 else ranks.get(sym[p] * KEY + sym[q], none)
            return none if r == none else r * size + p

        for p in range(n):
            tree[size + p] = leaf(p)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(p: int, value: int) -> None:
            i = size + p
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        while size > 1 and tree[1] < none:
            p = tree[1] % size
            q = after[p]
            sym[p], sym[q] = int(merged[tree[1] // size]), -1
            after[p] = after[q]
            if after[q] >= 0:
                before[after[q]] = p
            put(q, none)
            put(p, leaf(p))
            if before[p] >= 0:
                put(before[p], leaf(before[p]))
        return np.array([x for x in sym if x >= 0], np.int64)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes end."""
        lens = self.token_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ids) else 0
        return self.token_data[np.arange(total) + np.repeat(self.token_at[ids] - (ends - lens), lens)], ends


class Encoder:
    """Encodes slices of texts; memo: pre-tokens that are remembered at most."""

    def __init__(self, vocab: Vocabulary, memo: int = 200_000):
        self.vocab, self.memo = vocab, memo
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for text, i in self.vocab.special.items():
            self.index["\0special " + text] = len(self.count)
            self.ids, self.count = np.append(self.ids, i), np.append(self.count, 1)

    def pieces(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.vocab.special):
            out: list[str] = []
            for k, part in enumerate(self.special.split(text)):
                out += ["\0special " + part] if k % 2 else self.find(part)
            return out
        return self.find(text)

    def learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        lens = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lens) - lens
        power = np.ceil(np.log2(lens)).astype(int)
        base = len(self.count)
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        counts = np.zeros(len(new), np.int64)
        flat, where = [], []
        for e in np.unique(power):
            own = np.flatnonzero(power == e)
            if e >= 8 and len(own) <= 1 << (e - 4):  # few long ones
                for o in own:
                    ids = self.vocab.merge_one(data[starts[o] : starts[o] + lens[o]])
                    counts[o] = len(ids)
                    flat.append(ids)
                    where.append(np.array([o]))
                continue
            step = max(1, (1 << 21) >> int(e))
            for i in range(0, len(own), step):
                o = own[i : i + step]
                ids, n = self.vocab.merge(data, starts[o], lens[o])
                counts[o] = n
                flat.append(ids)
                where.append(o)
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for ids, o in zip(flat, where, strict=True):
            n = counts[o]
            out[np.repeat(at[o] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.ids, self.count = np.concatenate((self.ids, out)), np.concatenate((self.count, counts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the row offsets."""
        pieces = [self.pieces(t) for t in texts]
        new = list(set().union(*pieces).difference(self.index))
        if len(new) + len(self.index) > self.memo:
            self.clear()
            new = list(set().union(*pieces).difference(self.index))
        if new:
            self.learn(new)
        sizes = np.array([len(p) for p in pieces], np.int64)
        look = np.fromiter((self.index[p] for row in pieces for p in row), np.int64, int(sizes.sum()))
        at, n = (np.cumsum(self.count) - self.count)[look], self.count[look]
        ids = self.ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(sizes)]
        return ids, np.concatenate(([0], ends))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>, decoded): decoded is made from the ids alone. vocabulary: path of a tokenizers JSON file on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        vocab = Vocabulary(shared.value)
        encoder = Encoder(vocab)
        for b in batches:
            _, offs = string_buffers(b.column(1))
            for lo, hi in slices(offs, 1_000_000):
                ids, at = encoder.encode([t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()])
                data, ends = vocab.decode_bytes(ids)
                data, ends = data.tobytes(), np.concatenate(([0], ends))[at].tolist()
                decoded = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
                rows = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), rows, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return named.mapInArrow(lean(run), f"doc_id {dict(named.dtypes)['doc_id']}, ids array<int>, decoded string")
