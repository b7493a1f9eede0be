"""Quality rules by compression bands.

The zstandard ratio (bytes in / bytes out) of a whole document and of its fixed chunks is compared with limits that depend on
the length: text above its upper limit is repetitive, below its lower limit incompressible. A document is kept if it passes
the base rule and its whole ratio is in its band, and bytes of chunks outside the chunk band are at most `chunk_share`.

Defined results: a null or wordless text has zero counts, fails the base rule and is not kept; a null id stays null; repeated
rows each get their result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import NOT_SPACE, Rolling, cover, lean, mix, slices, string_buffers, word_spans


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio, by whole documents of under `below` bytes; the last row is for all longer ones."""

    limits: tuple[tuple[int, float, float], ...] = (
        # (below bytes, lowest ratio, highest ratio)
        (64, 0.0, 1.6), (128, 0.7, 1.8), (256, 0.85, 2.2), (512, 1.0, 2.3), (1 << 10, 1.15, 2.4), (1 << 11, 1.25, 2.5), (1 << 12, 1.35, 2.6),
        (1 << 13, 1.45, 2.7), (1 << 14, 1.5, 2.8), (1 << 15, 1.55, 2.9), (1 << 16, 1.6, 3.1), (1 << 17, 1.6, 3.4), (1 << 62, 1.6, 4.0),
    )
    chunk: int = 4096
    chunk_low: float = 1.35
    chunk_high: float = 3.0
    chunk_share: float = 0.4
    level: int = 3

    def verdict(self, size: int, ratio: float, bad_chunks: float) -> bool:
        low, high = next((a, b) for below, a, b in self.limits if size < below)
        return low <= ratio <= high and bad_chunks <= self.chunk_share


def counts(part: np.ndarray, at: np.ndarray, roll: tuple[Rolling, Rolling]) -> dict[str, np.ndarray]:
    """Base counts of each row of a slice."""
    s, e, first = word_spans(part, at, NOT_SPACE)
    n_words = np.diff(first)
    points = np.concatenate(([0], np.cumsum(NOT_SPACE[part] & ((part & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[part])))
    doc = np.repeat(np.arange(len(at) - 1), n_words)
    repeated = np.zeros(len(s) + 1, np.int64)
    if len(s) >= 3:
        h = roll[1].grams(roll[0].spans(part, s, e), 3)
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        key = h[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hit = inside[twice]
        repeated[1:] = np.cumsum(cover(hit, hit + 3, len(s)))
    return {
        "n_words": n_words, "word_chars": points[at[1:]] - points[at[:-1]], "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
    }


SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def ratios(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole text, share of its bytes in chunks outside the chunk band).

    What the last chunk lacks it takes from the bytes before it, so every byte is judged in a chunk of full size. A text of at most one chunk is judged as a whole,
    by the limits of its length.
    """
    if not text:
        return 0.0, 0.0
    whole, bad = len(text) / len(packer.compress(text)), 0
    if len(text) > bands.chunk:
        for i in range(0, len(text), bands.chunk):
            at = min(i, len(text) - bands.chunk)
            part = text[at : at + bands.chunk]
            if not bands.chunk_low <= len(part) / len(packer.compress(part)) <= bands.chunk_high:
                bad += min(bands.chunk, len(text) - i)
    return whole, bad / len(text)


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, ratio, bad_chunks, kept)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        roll, packer = (Rolling(31), Rolling(32)), zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            raw, offs = string_buffers(b.column(1))
            for lo, hi in slices(offs):
                part, at = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                c = counts(part, at, roll)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                data, edges = part.tobytes(), at.tolist()
                texts = [data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                lines = [duplicate_lines(t) for t in texts]
                measured = [ratios(t, bands, packer) for t in texts]
                kept = [not f and bands.verdict(len(t), *m) for f, t, m in zip(failed.tolist(), texts, measured, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *(pa.array(c[x].astype(np.int64)) for x in ("n_words", "word_chars", "n_symbols")), pa.array(lines, pa.int64()), pa.array(c["n_repeat_words"].astype(np.int64)),
                     pa.array(failed), pa.array([m[0] for m in measured], pa.float64()), pa.array([m[1] for m in measured], pa.float64()), pa.array(kept, pa.bool_())],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "bad_chunks", "kept"],
                )

    kind = dict(named.dtypes)["doc_id"]
    return named.mapInArrow(lean(run), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean")
