r"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text with a loss mask:

    ### user: How are you?</turn>
    ### assistant: Well, thanks.</turn>

Control strings inside texts and roles are escaped, so the output can be read back exactly: ``\`` is written ``\\``, ``###`` is ``\h``,
``</turn>`` is ``\c``, and a colon of a role is ``\;``. An escaped text holds neither control string.

A batch of turns is written at once: numpy finds what is escaped, sums up the segments' lengths to offsets, and scatters headers and contents
into one buffer, which becomes the Arrow column of the batch's conversations. The mask is a list of spans (code points of the formatted
text, end exclusive) of the trained roles' texts.

Defined results: turns are ordered by turn, role and text (nulls first), so rows of one turn number, and repeated rows, each stay, in a fixed order;
a null text or role is empty; rows without a conversation form one of their own, with a null id; a table without rows gives none; other columns are ignored. A conversation is one row of the
result and must fit into one Arrow string (2 GB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, string_buffers

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
MARK, END = np.frombuffer(b"###", np.uint8), np.frombuffer(b"</turn>", np.uint8)
#: Bytes of texts that are assembled at once; a longer conversation stands alone.
PART = 4 << 20


def _occurs(data: np.ndarray, what: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Starts of what in data that end within their row; last: each byte's number of bytes to its row's end."""
    n = len(data) - len(what) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:n] == what[0])
    for k in range(1, len(what)):
        at = at[data[at + k] == what[k]]
    return at[last[at] >= len(what)]


class Escaped:
    """Rows of bytes with their escapes: sizes of the rows, and put() to scatter them into a buffer."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, role: bool = False):
        self.data, rows = data, np.diff(offs)
        last = np.repeat(offs[1:], rows) - np.arange(len(data))
        marks = _occurs(data, MARK, last)
        if len(marks):  # every third of a run, from the left
            first = np.concatenate(([True], np.diff(marks) > 1))
            start = marks[np.maximum.accumulate(np.where(first, np.arange(len(marks)), 0))]
            marks = marks[(marks - start) % 3 == 0]
        ends = _occurs(data, END, last)
        changes = [(np.flatnonzero(data == 92), 92, 1), (marks, 104, 3), (ends, 99, 7)]
        if role:
            changes.append((np.flatnonzero(data == 58), 59, 1))
        size = np.ones(len(data), np.int64)
        for at, _, n in changes:
            for k in range(1, n):
                size[at + k] = 0
            size[at] = 2
        self.to = np.zeros(len(data) + 1, np.int64)
        np.cumsum(size, out=self.to[1:])
        self.changes, self.one = changes, np.flatnonzero(size == 1)
        self.offs = self.to[offs]
        self.sizes, self.rows = np.diff(self.offs), rows

    def put(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Write row i at starts[i]."""
        shift = np.repeat(starts - self.offs[:-1], self.rows)
        out[self.to[self.one] + shift[self.one]] = self.data[self.one]
        for at, code, _ in self.changes:
            to = self.to[at] + shift[at]
            out[to] = 92
            out[to + 1] = code


def _fill(out: np.ndarray, starts: np.ndarray, what: bytes) -> None:
    out[starts[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, trained: list[str]) -> tuple[pa.Array, pa.Array]:
    """(formatted, loss) of the conversations whose first turns' rows are `first` (ascending, from 0)."""
    role, text = Escaped(*string_buffers(roles), role=True), Escaped(*string_buffers(texts))
    sizes = len(OPEN) + role.sizes + len(MIDDLE) + text.sizes + len(CLOSE)
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    role_at = at[:-1] + len(OPEN)
    text_at = role_at + role.sizes + len(MIDDLE)
    out = np.empty(int(at[-1]), np.uint8)
    _fill(out, at[:-1], OPEN)
    role.put(out, role_at)
    _fill(out, role_at + role.sizes, MIDDLE)
    text.put(out, text_at)
    _fill(out, text_at + text.sizes, CLOSE)

    bounds = at[np.append(first, len(sizes))]
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    on = np.flatnonzero(pc.fill_null(pc.is_in(roles, pa.array(trained, pa.string())), False).to_numpy(zero_copy_only=False))
    base = points[bounds[:-1]][np.searchsorted(first, on, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array((points[p[on]] - base).astype(np.int32)) for p in (text_at, text_at + text.sizes)], ["start", "end"])
    edges = np.searchsorted(on, np.append(first, len(sizes))).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(edges), spans)


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss: array of (start, end)) of each conversation."""
    named = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    own = list(trained)

    def written(waiting):
        t = pa.Table.from_batches(waiting).combine_chunks()
        ids, roles, texts = (t.column(c).combine_chunks() if t.num_rows else t.column(c) for c in ("conv_id", "role", "text"))
        first = _starts(ids)
        sizes = np.append(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum(), 0)
        lo = 0
        while lo < len(first):  # by parts of whole conversations
            done = sizes[first[lo] - 1] if first[lo] else 0
            hi = max(lo + 1, int(np.searchsorted(sizes[np.append(first[lo + 1 :], t.num_rows) - 1] - done, PART, "right")) + lo)
            a, b = int(first[lo]), int(first[hi]) if hi < len(first) else t.num_rows
            formatted, loss = assemble(roles.slice(a, b - a), texts.slice(a, b - a), first[lo:hi] - a, own)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[lo:hi])), formatted, loss], ["conv_id", "formatted", "loss"])
            lo = hi

    def run(batches):
        waiting = []  # the last conversation may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(["conv_id", "role", "text"])
            cut = int(_starts(b.column(0))[-1])
            same = waiting and waiting[-1].column(0)[-1] == b.column(0)[0]
            if cut == 0 and same:
                waiting.append(b)
                continue
            head = b.slice(0, cut)
            if waiting or cut:
                yield from written([*waiting, *([head] if cut else [])])
            waiting = [b.slice(cut)]
        if waiting:
            yield from written(waiting)

    kind = dict(named.dtypes)["conv_id"]
    return dealt.mapInArrow(lean(run), f"conv_id {kind}, formatted string, loss array<struct<start:int,end:int>>")


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows where another id begins; nulls are one id."""
    if len(ids) < 2:
        return np.zeros(len(ids), np.int64)
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.concatenate(([0], np.flatnonzero(differ) + 1))


def unescape(text: Column) -> Column:
    r"""What escaping wrote, undone: an escaped backslash is \\ and every other escape a backslash and a letter, so pieces between \\ have none of the former."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\c"), F.lit("</turn>")), F.lit("\\;"), F.lit(":")))
    return F.array_join(plain, "\\")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of (role, text)) and trained (array of the texts under the loss mask), read from the formatted text alone."""
    parts = F.split("formatted", CLOSE.decode(), -1)
    heads = F.slice(parts, F.lit(1), F.size(parts) - 1)  # what follows the last closer is empty
    at = lambda p: F.instr(p, MIDDLE.decode())

    def turn(p):
        n = at(p)
        return F.struct(unescape(p.substr(F.lit(len(OPEN) + 1), n - len(OPEN) - 1)).alias("role"), unescape(p.substr(n + len(MIDDLE), F.length(p))).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(heads, turn), "trained": under})
