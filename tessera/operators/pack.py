"""Packing token arrays into blocks of equal length.

A document's offset is a running sum of lengths (in two phases over the lengths alone, see prefix), so every document knows which blocks it touches. It
explodes into its pieces, one for each block, and a block is put together from its own pieces only: no task sees more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators.tokens import fit, mask
from tessera.plans.lineage import cut, holds
from tessera.plans.prefix import running_sum


def pieces(df: DataFrame, keys: list[str], order: str, block_size: int, ids: str = "ids", lengths: str | None = None) -> DataFrame:
    """(keys, block_id, off, piece): each document's part of each block that it touches.

    The ids are written once, so that they are not made again for the lengths; a table that has been written with its lengths (a column) is read as it is.
    """
    if lengths:
        own = df.where(F.col(lengths) > 0).select(*keys, order, F.col(lengths).alias("__n"), ids)
    else:
        own = cut(df.where(F.size(ids) > 0).select(*keys, order, F.size(ids).cast("long").alias("__n"), ids), "ids")
    sized = running_sum(own, keys, order, "__n", "__off")
    first, last = F.floor(F.col("__off") / block_size), F.floor((F.col("__off") + F.col("__n") - 1) / block_size)
    each = sized.withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block_id") * block_size - F.col("__off"), F.lit(0))
    end = F.least((F.col("block_id") + 1) * block_size - F.col("__off"), F.col("__n"))
    return holds(each.select(*keys, "block_id", (F.col("__off") + begin).alias("off"), F.slice(ids, (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece")), own, sized)


def gathered(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, input_ids) of pieces; the last block of the keys may be shorter."""
    put = parts.groupBy(*keys, "block_id").agg(F.sort_array(F.collect_list(F.struct("off", "piece"))).alias("p"))
    return put.select(*keys, "block_id", F.flatten(F.col("p.piece")).alias("input_ids"))


def blocks(df: DataFrame, keys: list[str], order: str, block_size: int, ids: str = "ids", tail: str = "drop", pad: int = fixed.EOS, lengths: str | None = None) -> DataFrame:
    """(keys, block_id, input_ids, labels, attention_mask). tail: what becomes of the last, shorter block: "drop" or "pad"."""
    parts = pieces(df, keys, order, block_size, ids, lengths)
    out = gathered(parts, keys)
    if tail == "drop":
        out = out.where(F.size("input_ids") == block_size)
        return holds(out.select(*keys, "block_id", "input_ids", F.col("input_ids").alias("labels"), F.array_repeat(F.lit(1).cast("tinyint"), block_size).alias("attention_mask")), parts)
    return holds(out.select(*keys, "block_id", fit("input_ids", block_size, pad).alias("input_ids"), fit("input_ids", block_size, fixed.IGNORED).alias("labels"), mask("input_ids", block_size).alias("attention_mask")), parts)


def batch_blocks(df: DataFrame, pos: str, batch: int, block_size: int, ids: str = "ids", exclusive_tail: bool = True) -> DataFrame:
    """Blocks of each batch of rows on its own; with exclusive_tail the last block goes also where the length is an exact multiple."""
    own = df.withColumn("batch", F.floor(F.col(pos) / batch).cast("long"))
    out = blocks(own, ["batch"], pos, block_size, ids)
    if exclusive_tail:
        total = own.groupBy("batch").agg(F.sum(F.size(ids)).alias("__t"))
        out = out.join(total, "batch").where(F.col("block_id") < F.ceil(F.col("__t") / block_size) - 1).drop("__t")
    return out


def pad_batches(df: DataFrame, batch: str, ids: str = "ids", pad: int = fixed.EOS, most: int | None = None) -> DataFrame:
    """Rows padded to the longest of their batch (cut at most)."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    n = F.least(longest, F.lit(most)) if most else longest
    cut = F.slice(F.col(ids), F.lit(1), n)
    fill = F.greatest(n - F.size(cut), F.lit(0)).cast("int")
    return df.select(
        *[c for c in df.columns if c != ids], F.concat(cut, F.array_repeat(F.lit(pad), fill)).alias("input_ids"),
        F.concat(F.transform(cut, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
    )


def digest(ids) -> Column:
    """Hash of an id array's decimal text."""
    return F.sha2(F.array_join(F.transform(F.col(ids) if isinstance(ids, str) else ids, lambda x: x.cast("string")), ","), 256)


def block_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum(F.size(F.filter("attention_mask", lambda x: x == 1))).alias("tokens"))


def budget(block_size: int, batch: int, accumulate: int, tokens: int, milestones: list[int] = []) -> dict:  # noqa: B006
    """Steps of a token budget."""
    per_step = block_size * batch * accumulate
    return {"tokens_per_step": per_step, "max_steps": -(-tokens // per_step), "milestone_steps": {-(-m // per_step): m for m in milestones}, "blocks": -(-tokens // block_size)}
