"""Quality scores without gold labels: overlapping heuristic labellers, expectation-maximisation, hashed linear scorer.

Labellers vote good, bad or abstain on each document; abstaining is an outcome of its own, with a rate for each class. The counts
of vote patterns over the whole corpus are a bounded summary on which expectation-maximisation estimates the labellers' rates;
the posteriors of a bounded sample (about `sample_rows` texts, by a hash, of `sample_bytes` together; excerpts of very long ones) train a hashed linear scorer on word shapes, repeats and
words, which scores whole texts.

Defined results: a null or wordless text has all labellers abstain and scores by the bias alone; a null id stays null; repeated rows each
get their result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, NOT_SPACE, Rolling, cover, excerpt, fitting, lean, mix, slices, string_buffers, word_spans

LABELLERS = ("repeats", "symbols", "shouting", "tables", "echoes", "letters", "sentences", "variety")
#: Chance of voting (bad, good, abstaining) in bad and in good documents before the fit: what each rule is meant to be.
START = {
    "repeats": ((0.30, 0.00, 0.70), (0.004, 0.00, 0.996)), "symbols": ((0.30, 0.00, 0.70), (0.004, 0.00, 0.996)), "shouting": ((0.30, 0.00, 0.70), (0.004, 0.00, 0.996)),
    "tables": ((0.30, 0.00, 0.70), (0.004, 0.00, 0.996)), "echoes": ((0.30, 0.00, 0.70), (0.004, 0.00, 0.996)), "letters": ((0.45, 0.35, 0.20), (0.05, 0.85, 0.10)),
    "sentences": ((0.45, 0.35, 0.20), (0.05, 0.85, 0.10)), "variety": ((0.45, 0.35, 0.20), (0.05, 0.85, 0.10)),
}

LETTER, UPPER, DIGIT, STOP, SYMBOL, BAR = 1, 2, 4, 8, 16, 32
KIND = np.full(256, SYMBOL, np.uint8)
KIND[[*range(97, 123), *range(128, 256)]] = LETTER
KIND[65:91] = LETTER | UPPER
KIND[48:58] = DIGIT
KIND[list(b".,;:!?'\"()-")] = STOP
KIND[ord("|")] = BAR
DIM = 1 << 14


class Words:
    """Word features of a slice of texts."""

    def __init__(self, part: np.ndarray, at: np.ndarray, roll: Rolling):
        self.s, self.e, self.first = s, e, first = word_spans(part, at, NOT_SPACE)
        self.n = np.diff(first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.n)
        kind = KIND[part]
        self.kinds = np.zeros(0, np.uint8)
        upper = np.concatenate(([0], np.cumsum(kind & UPPER > 0)))
        letters = np.concatenate(([0], np.cumsum(kind & LETTER > 0)))
        self.letter_count, self.upper_count = (c[e] - c[s] for c in (letters, upper))
        self.size = e - s
        self.hash = roll.spans(LOWER[part], s, e) if len(s) else np.zeros(0, np.uint64)
        self.last = part[e - 1] if len(s) else np.zeros(0, np.uint8)
        self.double = (self.last == ord("!")) & (part[np.maximum(e - 2, 0)] == ord("!")) & (self.size > 1) if len(s) else np.zeros(0, bool)
        if len(s):
            # reduceat runs to the next start, over the white space between: take that out
            self.kinds = np.bitwise_or.reduceat(np.where(NOT_SPACE[part], kind, 0).astype(np.uint8), s)
        self.same = np.zeros(len(s), bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])

    def mean(self, x: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(x)))
        return (c[self.first[1:]] - c[self.first[:-1]]) / np.maximum(self.n, 1)

    def repeated(self, roll: Rolling, k: int = 5) -> np.ndarray:
        """Share of words in k-word windows found twice in the text."""
        hit = np.zeros(len(self.s), bool)
        if len(self.s) >= k:
            h = roll.grams(self.hash, k)
            inside = np.flatnonzero(self.doc[k - 1 :] == self.doc[: len(h)])
            key = h[inside] + mix(self.doc[inside].astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hit = cover(inside[twice], inside[twice] + k, len(self.s)) if len(key) else hit
        return self.mean(hit)

    def variety(self) -> np.ndarray:
        """Different words / words."""
        key = self.hash + mix(self.doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[order[1:]] = key[order][1:] != key[order][:-1]
        return self.mean(new)

    def votes(self, roll: Rolling) -> np.ndarray:
        """0 bad, 1 good, 2 abstains; a row for each text, a column for each labeller."""
        shout = self.mean((self.upper_count >= 2) & (self.upper_count == self.letter_count))
        symbol, bar, echo = self.mean(self.kinds & SYMBOL > 0), self.mean(self.kinds & BAR > 0), self.mean(self.same)
        alpha = self.mean(self.letter_count / np.maximum(self.size, 1))
        ends = self.mean(np.isin(self.last, np.frombuffer(b".!?", np.uint8)) & ~self.double)
        kinds = self.variety()
        fires = lambda x: np.where(x, 0, 2)
        scale = lambda low, high: np.where(low, 0, np.where(high, 1, 2))
        long = self.n >= 30
        out = np.stack([
            fires(self.repeated(roll) > 0.4), fires(symbol > 0.25), fires((shout > 0.5) & (self.n >= 5)), fires(bar > 0.2), fires((echo > 0.3) | (self.mean(self.double) > 0.3)),
            scale(alpha < 0.8, alpha > 0.93), scale((ends > 0.6) | ((ends < 0.02) & long), (ends > 0.03) & (ends < 0.4)), scale(long & (kinds < 0.2 + 3 / np.sqrt(np.maximum(self.n, 1)) * 0.3), kinds > 0.4),
        ], 1)
        out[self.n == 0] = 2
        return out

    def columns(self) -> list[np.ndarray]:
        """Hashed features, each a column of the scorer for every word: shape, shape after shape, word."""
        size = np.minimum(self.size // 3, 7).astype(np.uint64)
        case = np.where(self.upper_count == 0, 0, np.where(self.upper_count == self.letter_count, 2, 1)).astype(np.uint64)
        shape = self.kinds.astype(np.uint64) | (size << np.uint64(8)) | (case << np.uint64(12)) | (self.same.astype(np.uint64) << np.uint64(16)) | (self.double.astype(np.uint64) << np.uint64(17))
        before = np.concatenate((np.zeros(min(1, len(shape)), np.uint64), shape[:-1]))
        before[self.first[:-1][self.n > 0]] = 0
        return [(mix(x + np.uint64(salt)) % np.uint64(DIM)).astype(np.int64) for x, salt in ((shape, 1), (shape * np.uint64(1 << 20) + before, 2), (self.hash, 3))]


class Outcomes:
    """Class prior (of good) and each labeller's rates of its three outcomes in both classes."""

    def __init__(self):
        self.prior = 0.8
        self.rate = np.array([START[x] for x in LABELLERS])  # labeller, class, outcome
        self.rate = np.clip(self.rate, 1e-4, None)
        self.rate /= self.rate.sum(2, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        score = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for j in range(len(LABELLERS)):
            score += np.log(self.rate[j, 1, patterns[:, j]] / self.rate[j, 0, patterns[:, j]])
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, hold: float = 0.05) -> Outcomes:
        """hold: weight of the starting rates, as a share of the rows, so that class good keeps its meaning."""
        anchor, total = self.rate.copy(), counts.sum()
        for _ in range(rounds if len(patterns) else 0):
            before = self.rate.copy()
            p = self.posterior(patterns)
            self.prior = float(np.clip((counts * p).sum() / total, 0.05, 0.99))
            for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
                for j in range(len(LABELLERS)):
                    seen = np.bincount(patterns[:, j], weight, 3) + hold * total * anchor[j, c] * 0.2
                    self.rate[j, c] = np.clip(seen / seen.sum(), 1e-4, None)
            if np.abs(self.rate - before).max() < 1e-6:
                break
        return self


def slices_of(b: pa.RecordBatch, col: int, roll: Rolling):
    raw, offs = string_buffers(b.column(col))
    for lo, hi in slices(offs):
        yield lo, hi, Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], roll)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        roll = Rolling(51)
        for b in batches:
            for _, _, w in slices_of(b, 0, roll):
                key = w.votes(roll) @ 3 ** np.arange(len(LABELLERS))
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "n"])

    rows = docs.select(text_col).mapInArrow(lean(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()  # 3 ** labellers at most
    keys = np.array([r.k for r in rows], np.int64)
    return keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, np.array([r.n for r in rows], float)


def train_scorer(texts: list[str], labels: Outcomes, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Weights of DIM columns and a bias, by adaptive gradient steps on the posteriors."""
    roll = Rolling(51)
    weights = np.zeros(DIM + 1)
    docs, cols, values, targets = [], [], [], []
    for lo in range(0, len(texts), 200):
        batch = pa.RecordBatch.from_arrays([pa.array(texts[lo : lo + 200], pa.string())], ["t"])
        for at, _, w in slices_of(batch, 0, roll):
            key, count = np.unique(np.concatenate([w.doc * DIM + c for c in w.columns()]), return_counts=True)
            doc = key // DIM
            docs.append((doc + lo + at).astype(np.int32))
            cols.append((key % DIM).astype(np.int32))
            values.append((count / np.maximum(w.n[doc], 1)).astype(np.float32))
            targets.append(labels.posterior(w.votes(roll)))
    if not docs:
        return weights
    doc, col, value, target = map(np.concatenate, (docs, cols, values, targets))
    n = len(target)
    weights[DIM] = np.log(max(target.mean(), 0.01) / max(1 - target.mean(), 0.01))
    seen = np.full(DIM + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(doc, value * weights[col], n) + weights[DIM]
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(col, value * gap[doc], DIM) + ridge * weights[:DIM], gap.sum())
        seen += grad**2
        weights -= rate * grad / np.sqrt(seen)
    return weights


def scores(docs: DataFrame, sample_rows: int = 4_000, sample_bytes: int = 32_000_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, posterior: of the labellers' votes, score: of the linear scorer, predicted: 1 for good)."""
    patterns, counts = pattern_counts(docs, text_col)
    labels = Outcomes().fit(patterns, counts)
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    place = F.pmod(F.xxhash64(F.col(text_col), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    each, h = max(sample_bytes // 8, 1), F.xxhash64(F.col(text_col)).alias("h")
    drawn = docs.where(F.col(text_col).isNotNull() & (place < share))
    sizes = drawn.groupBy(h).agg(F.max(F.octet_length(text_col)).alias("bytes")).collect()  # about sample_rows numbers
    kept = fitting(sorted((r.h, r.bytes) for r in sizes), sample_bytes, each)
    few = docs.sparkSession.createDataFrame([(i,) for i in kept], "h long")
    sample = drawn.select(h, excerpt(F.col(text_col), each).alias("text")).join(F.broadcast(few), "h").select("text").distinct()  # as many hashes
    weights = train_scorer(sorted(r.text for r in sample.collect()), labels)
    shared = docs.sparkSession.sparkContext.broadcast((labels.prior, labels.rate, weights))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        model, roll = Outcomes(), Rolling(51)
        model.prior, model.rate, w = shared.value
        for b in batches:
            for lo, hi, x in slices_of(b, 1, roll):
                z = sum(x.mean(w[c]) for c in x.columns()) + w[DIM]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(model.posterior(x.votes(roll))), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "posterior", "score", "predicted"])

    return named.mapInArrow(lean(run), f"doc_id {dict(named.dtypes)['doc_id']}, posterior double, score double, predicted int")
