"""Personal data by weak supervision.

Exact pattern rules give the base spans. Beside them the method proposes candidate spans (assigned secrets, long opaque tokens,
titled names) on which labellers vote: pattern, gazetteer and context labellers, each for, against or abstaining.
Expectation-maximisation over the counts of vote patterns of the whole corpus estimates the labellers' reliabilities; its
posteriors train the final span classifier, a logistic model on the votes, the shape of the whole span and what stands around it, which decides
which candidates are added. The patterns of votes and shape classes are a bounded summary, so the fit sees every candidate of the corpus.

Base rules are scanned in time linear in the text: an e-mail grows around each @, an address starts only where a run of digits does.

Defined results: null and empty texts have no spans; a candidate that overlaps a base span or an added one is not added; positions are code
points with the end exclusive; a null id stays null; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean
from tessera.llm.em import WeakLabels, apply, logistic

KINDS = ("email", "ip", "card", "phone", "secret", "name")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[@0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        floor = max(done, at + 1)
        done = max(done, at + 1)
        at = text.find("@", floor)
    return out


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), sorted by start, then by kind as in KINDS."""
    if not ANY.search(text):
        return []
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


ASSIGNED = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z_-]+)["']?[ \t]*[=:][ \t]*["']?([A-Za-z0-9+/_.~-]{8,})""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
TITLED = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.? ([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)")

#: Names of settings that hold secrets, and common given names.
SECRET_KEYS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_token auth_token access_key secret_key private_key client_secret credential credentials key auth bearer".split())
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara maria anna peter hans klaus ursula sabine jean pierre marie claire luis carlos jose carmen ana juan sofia emma paul thomas laura julia martin eva".split())
CONTEXT = re.compile(r"(?i)pass(?:word|wd|phrase)|token|secret|api[ _-]?key|credential|login|auth|bearer|private|access")
NAME_CONTEXT = re.compile(r"(?i)\b(?:dear|contact|born|lives|signed|name|patient|customer|by)\b")
WORDY = re.compile(r"[A-Za-z]+")


def entropy(x: str) -> float:
    return -sum((n := x.count(c) / len(x)) * math.log2(n) for c in set(x))


def grade(value: float, *limits: float) -> int:
    """How many of the limits value reaches."""
    return sum(value >= x for x in limits)


def shape(text: str, s: int, e: int) -> tuple[int, ...]:
    """Classes of the whole span and of what stands around it: length, digits, capitals, signs, entropy, longest run of letters, vowels, sign before, line begin or end."""
    x = text[s:e]
    n = len(x)
    letters = [c for c in x if c.isalpha()]
    before = text[s - 1 : s]
    return (
        grade(n, 12, 20, 32), grade(sum(c.isdigit() for c in x) / n, 0.01, 0.2, 0.5), grade(sum(c.isupper() for c in x) / n, 0.01, 0.3, 0.7), grade(sum(not c.isalnum() for c in x) / n, 0.01, 0.15),
        grade(entropy(x), 2.5, 3.2, 3.8), grade(max((len(w) for w in WORDY.findall(x)), default=0), 6, 12), grade(sum(c in "aeiouAEIOU" for c in letters) / max(1, len(letters)), 0.15, 0.3, 0.45),
        1 if before in ("=", ":", '"', "'") else 2 if before.isspace() or not before else 0, int(text[e : e + 1] in ("", "\n")),
    )


def candidates(text: str) -> list[tuple[str, int, int, tuple]]:
    """(kind, start, end, pattern): pattern has the labellers' votes and the shape's classes."""
    out, taken = [], set()
    found = []
    if "=" in text or ":" in text:
        found = [(m[1].lower(), m.start(2), m.end(2)) for m in ASSIGNED.finditer(text)]
        taken = {(s, e) for _, s, e in found}
    found += [("", *m.span()) for m in OPAQUE.finditer(text) if m.span() not in taken]
    for key, s, e in found:
        x = text[s:e]
        has_digit, has_alpha = any(c.isdigit() for c in x), any(c.isalpha() for c in x)
        longest = max((len(w) for w in WORDY.findall(x)), default=0)
        votes = (
            1 if has_digit and has_alpha and len(x) >= 12 else 0,  # pattern
            None if not key else int(key in SECRET_KEYS),  # gazetteer
            int(bool(CONTEXT.search(text, max(0, s - 40), s))),  # context
            1 if entropy(x) >= 3.0 and has_digit else 0,  # entropy
            0 if longest >= 12 or not has_digit else None,  # words, paths
        )
        out.append(("secret", s, e, (*votes, *shape(text, s, e))))
    for m in TITLED.finditer(text):
        first = m[2].split(" ")[0].lower()
        votes = (1, 1 if first in GIVEN else None, 1 if NAME_CONTEXT.search(text, max(0, m.start() - 40), m.start()) else None, 1 if " " in m[2] else None, 0 if m[2].isupper() else None)
        out.append(("name", m.start(2), m.end(2), (*votes, *shape(text, m.start(2), m.end(2)))))
    return out


def added(text: str, base: list[tuple[str, int, int]], kept) -> list[tuple[str, int, int]]:
    """Candidates that kept(kind, pattern) accepts: none overlaps a base span or another; of two that overlap the one that starts first stays, then the longer."""
    starts, reach = [x[1] for x in base], [-1, *accumulate((x[2] for x in base), max)]
    out, end = [], -1
    for kind, s, e, p in sorted(candidates(text), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        # of the base spans that begin before e, the furthest end
        if s >= end and s >= reach[bisect_left(starts, e)] and kept(kind, p):
            out.append((kind, s, e))
            end = e
    return out


N_VOTES = 5
#: Numbers of classes of the parts of a shape.
CLASSES = (4, 4, 4, 3, 4, 3, 4, 3, 2)


def features(patterns: list[tuple]) -> np.ndarray:
    """For and against of each labeller, and the classes of the shape, one column each."""
    rows = [[f for v in p[:N_VOTES] for f in (float(v == 1), float(v == 0))] + [float(c == i) for c, n in zip(p[N_VOTES:], CLASSES, strict=True) for i in range(n)] for p in patterns]
    return np.array(rows, float).reshape(len(rows), 2 * N_VOTES + sum(CLASSES))


class SpanModel:
    """Per kind: labeller reliabilities and the final classifier."""

    def __init__(self, counts: dict[str, dict[tuple, int]]):
        self.labels, self.keep = {}, {}
        for kind, seen in counts.items():
            patterns = list(seen)
            n = [seen[p] for p in patterns]
            votes = [p[:N_VOTES] for p in patterns]
            self.labels[kind] = em = WeakLabels(N_VOTES).fit(votes, n)
            x = features(patterns)
            weight = np.array(n, float)
            b = logistic(x, em.posterior(votes), weight / weight.sum() * min(weight.sum(), 10_000))
            self.keep[kind] = dict(zip(patterns, apply(b, x).tolist(), strict=True))

    def chance(self, kind: str, pattern: tuple) -> float:
        return self.keep.get(kind, {}).get(pattern, 0.0)


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, dict[tuple, int]]:
    """Counts of all vote patterns of all texts, by kind: a bounded summary of the whole corpus."""

    def run(batches):
        for b in batches:
            seen: dict = {}
            for text in b.column(0).to_pylist():
                for kind, _, _, p in candidates(text or ""):
                    key = kind + "|" + ",".join("-" if v is None else str(v) for v in p)
                    seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    out: dict = {}
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        kind, _, p = r.pattern.partition("|")
        out.setdefault(kind, {})[tuple(None if v == "-" else int(v) for v in p.split(","))] = r.n
    return out


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base: array of (kind, start, end), spans: the base and the added ones, sorted)."""
    model = SpanModel(vote_counts(docs, text_col))
    kept = {(kind, p) for kind, by in model.keep.items() for p, c in by.items() if c >= threshold}
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for b in batches:
            base_rows, all_rows = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = added(text or "", base, lambda kind, p: (kind, p) in kept)
                base_rows.append(base)
                all_rows.append(sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))) if more else base)
            cols = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in rows], pa.list_(span)) for rows in (base_rows, all_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "spans"])

    kind = dict(named.dtypes)["doc_id"]
    one = "array<struct<kind: string, start: int, end: int>>"
    return named.mapInArrow(lean(run), f"doc_id {kind}, base {one}, spans {one}")
