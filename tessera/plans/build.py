"""End-to-end builds: sources to packed shards, conversations to supervised shards, and the held-out suite."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import sources as S
from tessera.functions import text as T
from tessera.operators import chat, mix, pack, tokens
from tessera.plans.lineage import cut, holds, release
from tessera.plans.prefix import global_rank, offsets
from tessera.sources import sinks


def positioned(df: DataFrame, *keys: str) -> DataFrame:
    """df, written, with __row (a number for each row) and pos: a place from 0 in an order of content hashes, for sources whose rows have none of their own.

    Rows of equal keys follow each other in any order. The order is found over hashes and row numbers alone.
    """
    own = df if "__row" in df.columns else cut(df.withColumn("__row", F.monotonically_increasing_id()), "rows", df)
    h = F.sha2(F.concat_ws("\0", *keys), 256)
    ranked = global_rank(own.select(h.alias("__h"), "__row"), "__h", ["__row"], "pos")
    return holds(own.join(ranked.select("__row", "pos"), "__row"), own, ranked)


@dataclass
class Counters:
    """What a build's one pass over a source counts: texts seen and accepted by the partition, and the accepted ones' chunks."""

    texts: dict[str, Observation] = field(default_factory=dict)
    chunks: dict[str, Observation] = field(default_factory=dict)

    def values(self) -> list[dict]:
        """A row for each source, once the pass has been written."""
        return [{"source": s, **self.texts[s].get, **self.chunks[s].get} for s in self.texts]


def prepared(spark: SparkSession, config: S.BuildConfig, counters: Counters | None = None) -> DataFrame:
    """(source, shard_id, chunk_no, text, is_chunked, wrapped): the accepted chunks of all sources, wrapped where chosen. One narrow stage, which also counts."""
    parts = []
    for s in config.sources:
        name = F.lit(s.label)
        rows = S.texts(S.scan(spark, s), s.text_fields or None).select(T.strip("text").alias("t"))
        held = T.in_holdout(name, F.col("t"), s.holdout_salt, s.holdout_rate)
        rows = rows.withColumn("own", (F.col("t") != "") & (held if s.partition == "eval" else ~held))
        if counters is not None:
            counters.texts[s.label] = Observation()
            filled = F.col("t") != ""
            rows = rows.observe(counters.texts[s.label], F.count_if(filled).alias("seen"), F.count_if("own").alias("accepted"), F.count_if(filled & ~F.col("own")).alias("skipped"))
        rows = rows.where("own")
        shard = T.shard_bucket(name, F.col("t"), s.holdout_salt, config.num_shards) if config.num_shards > 1 else F.lit(0)
        chunks = rows.select(name.alias("source"), shard.alias("shard_id"), (F.length("t") > s.long_text_chunk_chars).alias("is_chunked"), F.posexplode(T.text_chunks("t", s.long_text_chunk_chars)).alias("chunk_no", "x"))
        wrap = T.chat_wrapped(name, F.col("x"), s.holdout_salt, s.chatml_wrap_rate) if s.partition == "train" and s.chatml_wrap_rate > 0 else F.lit(False)
        chunks = chunks.withColumn("wrapped", wrap)
        if counters is not None:
            counters.chunks[s.label] = Observation()
            chunks = chunks.observe(counters.chunks[s.label], F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("is_chunked") & (F.col("chunk_no") == 0)).alias("chunked"), F.count_if("wrapped").alias("wrapped"))
        parts.append(chunks.withColumn("text", F.when(F.col("wrapped"), T.chatml_wrap("x")).otherwise(F.col("x"))).drop("x"))
    return reduce(DataFrame.unionByName, parts)


def within_budget(texts: DataFrame, order: DataFrame, tokenise, tokens: int, guess: float = 1.0, spare: float = 1.03) -> tuple[DataFrame, list[dict]]:
    """((shard_id, mix_pos, ids, n) of the first texts of each shard that together have at least so many tokens, what each round tokenised).

    texts: (__row, text). order: (__row, shard_id, mix_pos, bytes). Prefix sums of bytes say which texts a budget of bytes reaches, so no text beyond it is read by the
    tokeniser: the first round takes the bytes that `guess` bytes a token give, and further ones what is lacking by the rate of the round before, for shards that lack it alone.
    """
    spark = texts.sparkSession
    reach = cut(offsets(order, ["shard_id"], "mix_pos", "bytes", "from", stay=("__row",)), "reach")
    sizes = order.groupBy("shard_id").agg(F.sum("bytes").alias("bytes")).collect()  # a row for each shard
    total = {r.shard_id: r.bytes for r in sizes}
    done, got, rate, parts, rounds = dict.fromkeys(total, 0), dict.fromkeys(total, 0), dict.fromkeys(total, 1 / guess), [], []
    while open_ := [i for i in total if got[i] < tokens and done[i] < total[i]]:
        rows = []
        for i in open_:
            lacking = max(tokens - got[i], tokens // 200)
            rows.append((i, done[i], min(total[i], done[i] + int(lacking / rate[i] * spare) + 1)))
        limits = F.broadcast(spark.createDataFrame(rows, "shard_id int, done long, limit long"))  # a row for each shard
        now = reach.join(limits, "shard_id").where("`from` >= done and `from` < limit").select("__row", "shard_id", "mix_pos")
        seen = Observation()
        ids = tokenise(texts.join(now, "__row").select("shard_id", "mix_pos", "text")).withColumn("n", F.size("ids").cast("long"))
        part = cut(ids.observe(seen, F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")), "ids")
        parts.append(part)
        rounds.append({"shards": len(open_), **seen.get})
        new = {r.shard_id: r.n for r in part.groupBy("shard_id").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        for i, lo, hi in rows:
            got[i] += new.get(i, 0)
            rate[i] = new[i] / (hi - lo) if new.get(i) else rate[i] / 2
            done[i] = hi
    release(reach)
    if not parts:
        return cut(tokenise(texts.where("false").select(F.lit(0).alias("shard_id"), F.lit(0).cast("long").alias("mix_pos"), "text")).withColumn("n", F.size("ids").cast("long")), "ids"), rounds
    return holds(reduce(DataFrame.unionByName, parts), *parts), rounds


def build(spark: SparkSession, config: S.BuildConfig, root: str, tokenizer_json: str | None = None, bos: int = 0, eos: int = 1) -> DataFrame:
    """Writes all shards of a config in one pass over the sources and returns the manifest; too little data is an error.

    Without a tokenizer file the byte tokenizer is used. The pass that prepares the texts counts them; the order of the mix is found over hashes and sizes alone, and only texts
    that the budget reaches are tokenised. What the build has written on the way is deleted.
    """
    counters = Counters()
    texts = cut(prepared(spark, config, counters).withColumn("__row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("text").cast("long")), "chunks")
    narrow = texts.select("__row", "source", "shard_id", "bytes", F.sha2(F.concat_ws("\0", "source", "text", "chunk_no"), 256).alias("__h"))
    ranked = global_rank(narrow, "__h", ["__row"], "pos")
    placed = cut(ranked.drop("__h"), "places", ranked)
    mixed = mix.mix(placed, {s.label: s.weight for s in config.sources}, config.seed)
    order = cut(mixed.select("__row", "shard_id", "mix_pos", "bytes"), "order", mixed, placed)
    own = (lambda df: tokens.file_ids(df, tokenizer_json, bos=bos, eos=eos)) if tokenizer_json else tokens.byte_ids
    expected = -(-config.shard_tokens // config.block_size)
    ids, rounds = within_budget(texts.select("__row", "text"), order, own, expected * config.block_size, 4.0 if tokenizer_json else 1.0)
    packed = pack.blocks(ids, ["shard_id"], "mix_pos", config.block_size, lengths="n")
    manifest = sinks.write_shards(mix.token_budget(packed, config.shard_tokens, config.block_size), root, config.partition, expected, config.block_size)
    release(texts, order, packed, ids)
    done = manifest.collect()  # a row for each shard
    short = [r.shard_id for r in done if not r.complete]
    if short or len(done) < config.num_shards:
        raise ValueError(f"sources ran out before the budget of shards {short or 'that got no rows'}")
    sinks.write_metadata(spark, f"{root}/meta", {"partition": config.partition, "seed": config.seed, "block_size": config.block_size, "num_shards": config.num_shards, "sources": counters.values(), "tokenised": rounds})
    return manifest


def build_chat(spark: SparkSession, conversations: DataFrame, root: str, block_size: int = 1024, version: str = "v7", most: int = 8, weights: dict[str, float] | None = None, seed: int = 0, rows: int | None = None) -> DataFrame:
    """Writes one shard of supervised rows of conversations(source, conv_id, messages) and returns the manifest.

    With weights, rows are drawn over the sources by weight and the first `rows` stay.
    """
    from tessera.functions.fixed import MAX_ASSISTANT_TOKENS

    ready = chat.supervised_rows(chat.normalise(conversations, most=most, version=version), block_size, MAX_ASSISTANT_TOKENS[version])
    order = positioned(ready, "source", "conv_id")
    out = mix.mix(order, weights, seed).withColumnRenamed("mix_pos", "block_id") if weights else order.withColumnRenamed("pos", "block_id")
    if rows:
        out = out.where(F.col("block_id") < rows)
    blocks = out.select(F.lit(0).alias("shard_id"), "block_id", "input_ids", "labels", "attention_mask")
    return sinks.write_shards(blocks, root, "train", 1, block_size)


def eval_suite(spark: SparkSession, config: S.BuildConfig, root: str, canary: DataFrame | None = None) -> list[str]:
    """Builds the held-out set of each source and the canary set; what is complete already is left alone. Returns what was built."""
    built = []
    for s in config.sources:
        place = f"{root}/{s.label.replace('/', '_').replace('[', '_').replace(']', '')}"
        if not sinks._exists(spark, f"{place}/manifest"):
            held = S.Source(**(s.__dict__ | {"partition": "eval", "chatml_wrap_rate": 0.0}))
            build(spark, S.BuildConfig([held], config.seed, "eval", 1, config.block_size, config.shard_tokens), place)
            built.append(s.label)
    if canary is not None and not sinks._exists(spark, f"{root}/canary/manifest"):
        ids = tokens.byte_ids(positioned(canary.select("text"), "text"))
        blocks = pack.blocks(ids, [], "pos", config.block_size, tail="pad").select(F.lit(0).alias("shard_id"), "block_id", "input_ids", "labels", "attention_mask")
        sinks.write_shards(blocks, f"{root}/canary", "eval", 1, config.block_size)
        built.append("canary")
    return built


def load_suite(spark: SparkSession, root: str, subsets: list[str]) -> tuple[DataFrame, str]:
    """(blocks of all subsets with a subset column and, last, all of them as "all"; the name of the metric to go by)."""
    parts = [S.shards(spark, f"{root}/{n}").select(F.lit(n).alias("subset"), "block_id", "input_ids", "labels", "attention_mask") for n in subsets]
    every = reduce(DataFrame.unionAll, parts)
    if len(subsets) == 1:
        return every, "eval_loss"
    return every.unionAll(every.withColumn("subset", F.lit("all"))), "eval_all_loss"
