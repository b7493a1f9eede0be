"""Tokens: a byte tokenizer, any tokenizers file, and shapes of token arrays. Tokenizers are used, never trained."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions import fixed
from tessera.functions.text import strip
from tessera.operators import slices


IDS = ArrayType(IntegerType())
#: Fixed value: bytes of text that the tokenizers library encodes at once; its result keeps over a hundred bytes for each token.
ENCODED_BYTES = 1 << 18


def byte_ids(df: DataFrame, text: str = "text", bos: bool = True, eos: bool = True, drop_blank: bool = True) -> DataFrame:
    """df's other columns with ids: BOS, the stripped text's UTF-8 bytes + 4, EOS; blank texts are dropped (or just get the marks)."""
    rest = [c for c in df.columns if c not in (text, "ids")]
    ready = df.select(*rest, strip(text).alias("__t"))
    ready = ready.where("__t <> ''") if drop_blank else ready.withColumn("__t", F.coalesce("__t", F.lit("")))

    def run(batches):
        for b in (part for batch in batches for part in slices.by_bytes(batch)):
            raw = b.column(b.num_columns - 1).cast(pa.large_binary())
            offs = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            offs = offs - offs[0]
            marks = int(bos) + int(eos)
            out = np.zeros(len(data) + marks * len(raw), np.int32)
            row = np.repeat(np.arange(len(raw)), np.diff(offs))
            out[np.arange(len(data)) + row * marks + int(bos)] = data.astype(np.int32) + fixed.BYTE_SHIFT
            ends = offs + np.arange(len(raw) + 1) * marks
            if bos:
                out[ends[:-1]] = fixed.BOS
            if eos:
                out[ends[1:] - 1] = fixed.EOS
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*b.schema.names[:-1], "ids"])

    return ready.mapInArrow(run, ready.drop("__t").schema.add("ids", IDS))


def file_ids(df: DataFrame, tokenizer_json: str, text: str = "text", bos: int | None = None, eos: int | None = None) -> DataFrame:
    """df's other columns with ids by a tokenizers file (path on the driver); blank texts and empty results are dropped."""
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c not in (text, "ids")]
    ready = df.select(*rest, strip(text).alias("__t")).where("__t <> ''")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would hold the results of each
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        for b in (part for batch in batches for part in slices.by_bytes(batch, most=ENCODED_BYTES)):
            encoded = t.encode_batch_fast(b.column(b.num_columns - 1).to_pylist(), add_special_tokens=False)
            head, tail = [] if bos is None else [bos], [] if eos is None else [eos]
            ids = [head + e.ids + tail if e.ids else None for e in encoded]
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])
            yield out.filter(out.column(out.num_columns - 1).is_valid())

    return ready.mapInArrow(run, ready.drop("__t").schema.add("ids", IDS))


def with_eos(ids, eos: int = fixed.EOS, empty_too: bool = True) -> Column:
    """EOS at the end unless it is there; an empty array becomes [EOS] or stays empty."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    added = F.when(F.element_at(ids, -1) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))
    return F.when(F.size(ids) == 0, F.array(F.lit(eos)) if empty_too else ids).otherwise(added)


def fit(ids, length: int, pad: int) -> Column:
    """Cut to length, or padded at the end."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(cut), F.lit(0)).cast("int")))


def mask(ids, length: int) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1).cast("tinyint"), n), F.array_repeat(F.lit(0).cast("tinyint"), F.lit(length) - n))


def estimated_tokens(text) -> Column:
    """A quarter of the characters."""
    return F.length(F.col(text) if isinstance(text, str) else text) / F.lit(4.0)


def validate(tokenizer_json: str, special: dict[str, int], samples: list[str]) -> list[tuple[str, bool, str]]:
    """Checks of a tokenizer file: special ids, all byte symbols, round trips."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(tokenizer_json)
    out = [(f"special:{k}", t.token_to_id(k) == v, str(t.token_to_id(k))) for k, v in special.items()]
    missing = [c for c in pre_tokenizers.ByteLevel.alphabet() if t.token_to_id(c) is None]
    out.append(("byte_alphabet", not missing, f"{len(missing)} missing"))
    for s in samples:
        back = t.decode(t.encode(s, add_special_tokens=False).ids, skip_special_tokens=False)
        out.append(("round_trip", back == s, repr(back)[:60]))
    return out
