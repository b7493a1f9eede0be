"""Supervised rows of instruction examples: the prompt is masked, the response and the end mark are learnt."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.operators import slices


def instruction_rows(df: DataFrame, length: int, tokenizer_json: str | None = None, eos: int = fixed.EOS, least: int = 8, end_learnt: bool = True) -> DataFrame:
    """df's other columns with input_ids, labels and attention_mask of (instruction, input, output), cut to length; rows of at most `least` tokens are dropped.

    Labels are IGNORED for every token that begins inside the prompt, told by the tokens' offsets in the whole text: a token that spans the border belongs to the prompt. EOS
    is added where there is room and it is not there yet; end_learnt=False leaves it out of the labels. Without a tokenizers file the byte tokenizer is used.
    """
    rest = [c for c in df.columns if c not in ("instruction", "input", "output", "input_ids", "labels", "attention_mask")]
    ready = df.withColumn("__p", T.instruction_prompt("instruction", "input")).select(*rest, F.length("__p").alias("__n"), F.concat("__p", T.strip(F.coalesce("output", F.lit("")))).alias("__t"))
    shared = None
    if not tokenizer_json:  # a token is a byte, so what lies beyond `length` characters is beyond the cut
        ready = ready.withColumn("__t", F.left("__t", F.lit(length)))
    if tokenizer_json:
        with open(tokenizer_json, encoding="utf-8") as f:
            shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file

    def by_bytes(text: str, prompt: int) -> tuple[list[int], int]:
        return [b + fixed.BYTE_SHIFT for b in text.encode()], len(text[:prompt].encode())

    def by_file():
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        t.no_truncation()

        def encoded(text: str, prompt: int) -> tuple[list[int], int]:
            e = t.encode(text, add_special_tokens=False)
            return e.ids, next((i for i, (begin, _) in enumerate(e.offsets) if begin >= prompt), len(e.ids))

        return encoded

    def row(ids: list[int], masked: int) -> tuple[list[int], list[int]]:
        labels = [fixed.IGNORED] * masked + ids[masked:]
        ids, labels = ids[:length], labels[:length]
        if len(ids) < length and (not ids or ids[-1] != eos):
            ids, labels = [*ids, eos], [*labels, eos if end_learnt else fixed.IGNORED]
        return ids, labels

    def run(batches):
        encode = by_file() if shared else by_bytes
        for b in (part for batch in batches for part in slices.by_bytes(batch, most=1 << 18)):
            rows = [row(*encode(t, n)) for t, n in zip(b.column(b.num_columns - 1).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True)]
            ids, labels = (pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1))
            mask = pa.array([[1] * len(r[0]) for r in rows], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], ids, labels, mask], [*b.schema.names[:-2], "input_ids", "labels", "attention_mask"])

    schema = ready.drop("__n", "__t").schema.add("input_ids", ArrayType(IntegerType())).add("labels", ArrayType(IntegerType())).add("attention_mask", ArrayType(ByteType()))
    return ready.mapInArrow(run, schema).where(F.size("input_ids") > least)
