"""Toxicity by a weighted finite-state pattern grammar.

Words and marks of a text are read as symbols (insult, harm verb, intent verb, target, negation, reporting verb, quotation mark, comma, colon, end of
sentence). A composition of transducers (see `grammar`) matches clauses and writes their classes: directed, plain, negated or reported insult, and
threat; a matched clause is scored, not an isolated word. The insult lexicon is a fixed list and stems that labelled rows teach:
beginnings of words that occur nearly only in toxic rows and next to many different words (so that copies of one text teach nothing). A
logistic model gives the clause classes their weights.

Labels, language, source and ids are never inputs of a score. The fit reads a bounded sample of labelled rows (`sample_rows`
by a hash of the id, of `sample_bytes` of text together); scoring reads whole texts.

Defined results: null, empty and clean texts get the score of no matched clause; without labels the fixed list and fixed weights
are used; of several labels of one id the largest counts, of several texts the least; a null id is scored (and is no held-out row); repeated rows each get
their result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.em import apply, logistic
from tessera.llm.grammar import CLASSES, Grammar
from tessera.llm.shared import excerpt, fitting, holds, lean

#: The grammar's word classes.
INSULTS = frozenset("idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting imbecile dumbass asshole bastard bitch trash clown".split())
TARGETS = frozenset("you your you're youre yourself u he she they him her them his their these those all everyone du dich dir ihr euch sie tu te toi vous tú te usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nobody nicht kein keine nie pas jamais ne nunca ni".split())
REPORTS = frozenset("said says called calls wrote writes quoted claimed reported alleged allegedly sagte nannte dit dijo llamó".split())
INTENT = frozenset("will shall gonna going want should must werde voy vais i'll we'll".split())
HARM = frozenset("kill hurt beat stab shoot destroy murder burn töten tuer matar".split())
MARKS = {"\"": "quote", "“": "quote", "”": "quote", "„": "quote", "«": "quote", "»": "quote", ",": "comma", ":": "colon"}
ROLES = {w: role for role, words in (("harm", HARM), ("intent", INTENT), ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in words}
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”„«»,:]|[.!?;]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

SHORTEST, LONGEST = 4, 8


def plain(text: str) -> str:
    """Lower case, with one kind of apostrophe."""
    return text.lower().replace("’", "'")


def held_out(id_col: str | Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text has remainder 2 by 4."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Lexicon:
    """Whole words and word beginnings with weights."""

    def __init__(self, stems: dict[str, float] | None = None):
        self.stems = dict(stems or {})
        whole = {s[:-1] for s in self.stems if s.endswith("$")} | INSULTS
        starts = {s for s in self.stems if not s.endswith("$")}
        parts = [re.escape(w) + r"(?![^\W_])" for w in sorted(whole, key=len, reverse=True)] + [re.escape(w) for w in sorted(starts, key=len, reverse=True)]
        self.any = re.compile(r"(?<![^\W_])(?:" + "|".join(parts) + ")")
        self.harm = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(HARM)) + r")(?![^\W_])")

    def insult(self, word: str) -> bool:
        return bool(self.any.match(word))


GRAMMAR = Grammar()


def symbols(line: str, lexicon: Lexicon) -> list[str]:
    """The symbols of a line, read from the left."""
    out = []
    for t in TOKEN.findall(line):
        mark = MARKS.get(t)
        if mark:
            out.append(mark)
        elif t[0] in ".!?;":
            out.append("stop")
        else:
            out.append("insult" if lexicon.insult(t) else ROLES.get(t, "word"))
    return out


def matched(text: str, lexicon: Lexicon) -> Counter:
    """Clause classes of a whole text; lines without an insult or harm word have none and are passed over."""
    low, out, done = plain(text), Counter(), 0
    spots = sorted([m.start() for m in lexicon.any.finditer(low)] + [m.start() for m in lexicon.harm.finditer(low)])
    for at in spots:
        if at < done:
            continue
        start, end = low.rfind("\n", done, at) + 1 or done, low.find("\n", at)
        end = len(low) if end < 0 else end
        out.update(GRAMMAR.classes(symbols(low[start:end], lexicon)))
        done = end
    return out


def features(found: Counter) -> list[float]:
    return [min(1.0, found[c]) for c in CLASSES] + [math.log1p(found[c]) for c in CLASSES]


def stems_of(word: str) -> list[str]:
    """The word itself (with an end mark) and its beginnings."""
    return [word + "$"] + [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def learn_stems(rows: list[tuple[str, int]], contexts: int = 8, precision: float = 0.97) -> dict[str, float]:
    """Stems of toxic rows: nearly only there, and after many different words."""
    n = Counter(t for _, t in rows)
    if not n[1] or not n[0]:
        return {}
    toxic: Counter = Counter()
    for text, label in rows:
        if label:
            toxic.update({s for w in set(WORD.findall(plain(text))) for s in stems_of(w)})
    able = {s for s, c in toxic.items() if c >= 3}
    clean: Counter = Counter()
    known: dict[str, tuple[str, ...]] = {}
    for text, label in rows:
        if not label:
            seen: set[str] = set()
            for w in set(WORD.findall(plain(text))):
                if w not in known:
                    known[w] = tuple(s for s in stems_of(w) if s in able)
                seen.update(known[w])
            clean.update(seen)
    score = {s: toxic[s] / n[1] / (toxic[s] / n[1] + clean[s] / n[0]) for s in able}
    good = {s for s in able if score[s] >= precision and clean[s] <= 0.02 * toxic[s] * n[0] / n[1]}
    before: dict[str, set] = {s: set() for s in good}
    for text, label in rows:
        if label:
            words = WORD.findall(plain(text))
            for prev, w in zip(["", *words], words, strict=False):
                for s in stems_of(w):
                    if s in good:
                        before[s].add(prev)
    need = max(3, min(contexts, n[1] // 3))
    good = {s for s in good if len(before[s]) >= need}
    # of a chain of beginnings keep the longest that covers most of the shortest's contexts
    out: dict[str, float] = {}
    for s in sorted(good, key=lambda x: (len(x), x)):
        bare = s.rstrip("$")
        if any(bare.startswith(x) for x in out if not x.endswith("$")) or s in out:
            continue
        best, spread = s, len(before[s])
        for x in sorted((x for x in good if x != s and x.rstrip("$").startswith(bare)), key=lambda x: (len(x), x)):
            if len(before[x]) >= 0.6 * spread:
                best = x
        out[best] = score[best]
        if best != s and len(before[best]) < 0.95 * spread:
            out[s] = score[s]
    return out


class Model:
    """Lexicon and the weights of the clause classes."""

    #: Used without labels.
    FIXED = np.array([2.0, 1.5, -0.5, -0.5, 3.0, 1.0, 1.0, 0.2, 0.2, 1.0, -3.0])

    def __init__(self, rows: list[tuple[str, int]]):
        rows = [(t or "", int(y)) for t, y in rows if y is not None]
        self.lexicon = Lexicon(learn_stems(rows))
        y = np.array([y for _, y in rows], float)
        if 0 < y.sum() < len(y):
            x = np.array([features(matched(t, self.lexicon)) for t, _ in rows])
            self.weights = logistic(x, y, np.ones(len(y)), ridge=0.5)
        else:
            self.weights = self.FIXED

    def score(self, text: str) -> float:
        return float(apply(self.weights, np.array(features(matched(text, self.lexicon)))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, sample_bytes: int = 48_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model of labelled rows that are not held out: at most sample_rows, in the order of a hash of the id, as far as they fit into sample_bytes together.

    They are chosen by their sizes before a text is fetched. Of a text of over an eighth of sample_bytes excerpts from all over it stand in, so that no text keeps the others out.
    """
    each = max(sample_bytes // 8, 1)
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = named.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # sample_rows rows at most
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"), F.max("label").alias("label"), F.xxhash64("doc_id").alias("h")).collect()  # sample_rows numbers
    label = {r.doc_id: r.label for r in sizes}
    kept = fitting([(r.doc_id, r.bytes) for r in sorted(sizes, key=lambda r: (r.h, r.doc_id))], sample_bytes, each)
    few = docs.sparkSession.createDataFrame([(i,) for i in kept], f"doc_id {dict(named.dtypes)['doc_id']}")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id")  # sample_rows ids at most
    own = own.groupBy("doc_id").agg(F.min(excerpt(F.col("text"), each)).alias("text"))
    return Model([(r.text, label[r.doc_id]) for r in sorted(own.collect(), key=lambda r: r.doc_id)])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, clauses: number of matched clauses by class)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.stems, model.weights))

    def run(batches):
        stems, weights = shared.value
        lexicon = Lexicon(stems)
        for b in batches:
            found = [matched(t or "", lexicon) for t in b.column(1).to_pylist()]
            x = np.array([features(f) for f in found]).reshape(len(found), 2 * len(CLASSES))
            names = pa.array([c for f in found for c in CLASSES if f[c]], pa.string())
            numbers = pa.array([f[c] for f in found for c in CLASSES if f[c]], pa.int32())
            offs = pa.array(np.concatenate(([0], np.cumsum([sum(f[c] > 0 for c in CLASSES) for f in found]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(apply(weights, x)), pa.MapArray.from_arrays(offs, names, numbers)], ["doc_id", "score", "clauses"])

    return named.mapInArrow(lean(run), f"doc_id {dict(named.dtypes)['doc_id']}, score double, clauses map<string, int>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows of a score of threshold or more."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.stems, model.weights))

    def run(batches):
        stems, weights = shared.value
        lexicon = Lexicon(stems)
        for b in batches:
            x = np.array([features(matched(t or "", lexicon)) for t in b.column(place).to_pylist()]).reshape(b.num_rows, 2 * len(CLASSES))
            yield b.filter(pa.array(apply(weights, x) < threshold))

    return holds(docs.mapInArrow(lean(run), docs.schema), shared)
