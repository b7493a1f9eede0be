"""Conversations: normalisation, usability, supervised token rows, message trees. In array functions and joins; only bytes become tokens in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.operators import slices
from tessera.plans.lineage import cut, holds

MESSAGE = "array<struct<role:string,content:string>>"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(conv, messages) from a row for each turn, in turn order."""
    got = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("m"))
    return got.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def cleaned(messages: Column) -> Column:
    """Known roles with stripped text; others are dropped."""
    out = F.transform(messages, lambda m: F.struct(T.normalise_role(m["role"]).alias("role"), T.strip(m["content"]).alias("content")))
    return F.filter(out, lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))


def merged(messages: Column) -> Column:
    """Neighbours of one role become one message, their texts set apart by an empty line."""

    def step(done, m):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit("\n\n"), m["content"]).alias("content"))
        grown = F.concat(done, F.array(m))
        same = F.coalesce(last["role"] == m["role"], F.lit(False))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(grown)

    return F.aggregate(messages, F.array().cast(MESSAGE), step)


def capped(messages: Column, most: int) -> Column:
    """A leading system message, then the last `most` others; later system messages go; what follows the last answer goes."""
    lead = F.filter(F.slice(messages, 1, 1), lambda m: m["role"] == "system")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    kept = F.when(F.size(rest) > most, F.slice(rest, F.size(rest) - most + 1, F.lit(most))).otherwise(rest)
    both = F.concat(lead, kept)
    end = F.size(both) - F.greatest(F.array_position(F.transform(F.reverse(both), lambda m: m["role"]), "assistant") - 1, F.lit(-1))
    has = F.exists(both, lambda m: m["role"] == "assistant")
    return F.when(has, F.slice(both, F.lit(1), end.cast("int"))).otherwise(F.array().cast(MESSAGE))


def has_both(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "assistant") & F.exists(messages, lambda m: m["role"] == "user")


def usable(messages: Column, version: str = "v7") -> Column:
    """Every answer usable, the last one of 8 words or more; v5 also refuses programming requests."""
    answers = F.filter(messages, lambda m: m["role"] == "assistant")
    ok = has_both(messages) & F.forall(answers, lambda m: T.assistant_usable(m["content"], fixed.MAX_ASSISTANT_WORDS[version]))
    ok &= T.word_count(F.try_element_at(answers, F.lit(-1))["content"]) >= 8
    if version == "v5":
        ok &= ~F.exists(F.filter(messages, lambda m: m["role"] == "user"), lambda m: T.programming_request(m["content"]))
    return F.coalesce(ok, F.lit(False))


def normalise(df: DataFrame, messages: str = "messages", most: int = 8, version: str = "v7") -> DataFrame:
    """df with normalised messages; conversations without both sides, and from v5 on unusable ones, are dropped."""
    # each step is a projection of its own, so that no expression is written out again inside the next
    out = df.withColumn(messages, cleaned(F.col(messages)))
    out = out.withColumn(messages, merged(F.col(messages)))
    out = out.withColumn(messages, capped(F.col(messages), most)).where(has_both(F.col(messages)))
    return out if version == "v4" else out.where(usable(F.col(messages), version))


def alias_fields(role: list[Column], content: list[Column]) -> Column:
    """A message from fields that may have other names; empty ones fall through."""
    return F.struct(T.first_filled(*role).alias("role"), T.first_filled(*content).alias("content"))


def text_ids(c: Column) -> Column:
    """Byte token ids of a text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + fixed.BYTE_SHIFT)


def turn_parts(messages: Column, most_tokens: int | None) -> Column:
    """Per turn: role, header, content (answers cut) and closer as bytes: a byte token each."""

    def one(m):
        body = F.encode(m["content"], "UTF-8")
        if most_tokens:
            body = F.when(m["role"] == "assistant", F.substring(body, 1, most_tokens)).otherwise(body)
        return F.struct(m["role"].alias("role"), F.encode(F.concat(F.lit(fixed.IM_START), m["role"], F.lit("\n")), "UTF-8").alias("head"), body.alias("body"), F.encode(F.lit(fixed.IM_END + "\n"), "UTF-8").alias("close"))

    return F.transform(messages, one)


def drop_starts(messages: Column, lead: Column) -> Column:
    """Places at which the rest may start: after the lead, then after each drop of the oldest turn and an answer right behind it."""
    zero = F.struct((lead + 1).alias("next"), F.array().cast("array<int>").alias("starts"))

    def step(done, i):
        behind = F.coalesce(F.try_element_at(messages, i + 1)["role"] == "assistant", F.lit(False))
        hit = F.struct(F.when(behind, i + 2).otherwise(i + 1).alias("next"), F.concat(done["starts"], F.array(i)).alias("starts"))
        return F.when(i == done["next"], hit).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.size(messages)), zero, step)["starts"]


def fitted(parts: Column, block_size: int) -> Column:
    """Turns left after dropping the oldest ones (an answer goes with its question) until all fits with the end mark.

    The number dropped is the smallest that fits; suffix sums of the turns' sizes tell it without trial.
    """

    def chosen(p, sizes):
        n = F.size(p)
        lead = F.when(F.element_at(p, 1)["role"] == "system", F.lit(1)).otherwise(F.lit(0))
        kept_size = F.when(lead == 1, F.element_at(sizes, 1)).otherwise(F.lit(0)) + 1
        # suffix[i]: tokens of the turns from i on
        suffix = F.reverse(F.aggregate(F.reverse(sizes), F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))))

        def pick(suffix):
            fits = F.filter(drop_starts(p, lead), lambda i: F.element_at(suffix, i) + kept_size <= block_size)
            first = F.try_element_at(fits, F.lit(1))
            return F.when(first.isNotNull(), F.concat(F.slice(p, F.lit(1), lead), F.slice(p, first, n - first + 1))).otherwise(F.slice(p, 1, 0))

        return T.let(suffix, pick)

    size = lambda p: F.octet_length(p["head"]) + F.octet_length(p["body"]) + F.octet_length(p["close"])
    return T.let(parts, lambda p: T.let(F.transform(p, size), lambda sizes: chosen(p, sizes)))


def supervised_rows(df: DataFrame, block_size: int, most_tokens: int | None = 256, messages: str = "messages", early: int = fixed.EARLY_LABELS, pad: int = fixed.EOS) -> DataFrame:
    """df's other columns with input_ids, labels, attention_mask, supervised: one padded row for each conversation.

    Labels are the answers' contents and closers; rows that do not fit, or are supervised within the first `early` places, go. Which turns stay is decided by
    their sizes; only the bytes of those become tokens, for all rows of a batch at once.
    """
    rest = [c for c in df.columns if c != messages]
    kept = df.select(*rest, fitted(turn_parts(F.col(messages), most_tokens), block_size).alias("__p")).where(F.exists("__p", lambda p: p["role"] == "assistant"))
    whole = F.aggregate("__p", F.encode(F.lit(""), "UTF-8"), lambda done, p: F.concat(done, p["head"], p["body"], p["close"]))
    spans = F.flatten(F.transform("__p", lambda p: F.array(F.octet_length(p["head"]), F.octet_length(p["body"]) + F.octet_length(p["close"]))))
    learnt = F.flatten(F.transform("__p", lambda p: F.array(F.lit(False), p["role"] == "assistant")))
    ready = kept.select(*rest, whole.alias("__w"), spans.alias("__n"), learnt.alias("__a"))

    def run(batches):
        for b in (part for batch in batches for part in slices.by_rows(batch, (1 << 20) // block_size)):
            raw, spans, learnt = b.columns[-3:]
            raw = raw.cast(pa.large_binary())
            offs = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(raw) else np.zeros(0, np.uint8)
            n = np.diff(offs)
            row, rows = np.repeat(np.arange(len(raw)), n), np.arange(len(raw))
            place = np.arange(len(data)) - np.repeat(offs[:-1] - offs[0], n)
            on = np.repeat(learnt.flatten().to_numpy(zero_copy_only=False).astype(bool), spans.flatten().to_numpy()) if len(data) else np.zeros(0, bool)
            ids, labels, live = np.full((len(raw), block_size), pad, np.int32), np.full((len(raw), block_size), fixed.IGNORED, np.int32), np.zeros((len(raw), block_size), np.int8)
            token = data.astype(np.int32) + fixed.BYTE_SHIFT
            ids[row, place], live[row, place] = token, 1
            labels[row[on], place[on]] = token[on]
            ids[rows, n] = labels[rows, n] = fixed.EOS
            live[rows, n] = 1
            good = np.flatnonzero((labels[:, :early] == fixed.IGNORED).all(1))
            size = pa.array(np.arange(len(good) + 1, dtype=np.int32) * block_size)
            arrays = [pa.ListArray.from_arrays(size, pa.array(x[good].ravel())) for x in (ids, labels, live)]
            supervised = pa.array((labels[good] != fixed.IGNORED).sum(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(good)) for c in b.columns[:-3]), *arrays, supervised], [*b.schema.names[:-3], "input_ids", "labels", "attention_mask", "supervised"])

    schema = ready.drop("__w", "__n", "__a").schema.add("input_ids", ArrayType(IntegerType())).add("labels", ArrayType(IntegerType())).add("attention_mask", ArrayType(ByteType())).add("supervised", IntegerType())
    return ready.mapInArrow(run, schema)


def trimmed_history(messages: Column, limit: int) -> Column:
    """Messages left after dropping the oldest turns until the rendered prompt's bytes fit; the last state if none does."""
    n = F.size(messages)
    lead = F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", F.lit(1)).otherwise(F.lit(0))
    starts = drop_starts(messages, lead)
    rest = lambda i: F.concat(F.slice(messages, F.lit(1), lead), F.slice(messages, i, n - i + 1))
    fits = F.filter(starts, lambda i: F.octet_length(T.render_chat(rest(i))) <= limit)
    first = F.coalesce(F.try_element_at(fits, F.lit(1)), n + 1)
    return rest(first)


def label_stats(df: DataFrame, labels: str = "labels") -> DataFrame:
    """One row: samples, empty ones, quantiles (linear) of first supervised place, share and number of supervised labels."""
    active = F.filter(F.transform(labels, lambda x, i: F.when(x != fixed.IGNORED, i)), lambda i: i.isNotNull())
    own = df.select(F.try_element_at(active, F.lit(1)).alias("first"), F.size(active).alias("n"), F.size(labels).alias("size"))
    share = F.when(F.col("n") > 0, F.col("n") / F.col("size"))
    n = F.when(F.col("n") > 0, F.col("n"))
    q = lambda c, p: F.percentile(c, p)
    return own.agg(
        F.count("*").alias("samples"), F.count_if(F.col("n") == 0).alias("empty"), q("first", 0.5).cast("int").alias("first_p50"), q("first", 0.9).cast("int").alias("first_p90"),
        q("first", 0.99).cast("int").alias("first_p99"), q(share, 0.5).alias("share_p50"), q(share, 0.9).alias("share_p90"), q(n, 0.5).cast("int").alias("count_p50"), q(n, 0.9).cast("int").alias("count_p90"),
    )


def best_children(nodes: DataFrame) -> DataFrame:
    """Per (parent_id, role) the best child: lowest rank, else the first accepted, else the first in input order (input_pos)."""
    w = Window.partitionBy("parent_id", "role").orderBy(F.col("rank").asc_nulls_last(), F.coalesce(F.col("accepted"), F.lit(False)).desc(), "input_pos")
    return nodes.where("parent_id is not null and parent_id <> ''").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: One recursive relation: a row for each message of a path, from the frontier of the step before.
WALK = """
with recursive walk (root_id, at, role, content, step, n) as (
  select root_id, at, role, content, 0, n from {roots}
  union all
  select w.root_id, c.m, c.r, c.t, w.step + 1, w.n + 1 from walk w join {children} c on c.p = w.at and c.r = case when w.role = 'assistant' then 'user' else 'assistant' end where w.n < {most}
)
select root_id, transform(array_sort(collect_list(struct(step, role, content))), x -> struct(x.role as role, x.content as content)) as messages from walk group by root_id
"""


def tree_paths(nodes: DataFrame, most: int = 8, only: str | None = "en") -> DataFrame:
    """(root_id, messages): one conversation for each root, alternating roles through the best children.

    nodes: message_id, parent_id, role, text, lang, rank, accepted, input_pos. A message of another language prunes what hangs below it. The walk is one recursive
    relation whose frontier has a row for each path that goes on; best children are written once and joined to it at each step.
    """
    spark = nodes.sparkSession
    own = nodes.where(F.col("lang").isNull() | (F.col("lang") == only)) if only else nodes
    own = own.where("message_id is not null and message_id <> ''").withColumn("role", T.normalise_role("role")).withColumn("text", T.strip("text")).where("role is not null")
    best = best_children(own).where("text <> ''").select(F.col("parent_id").alias("p"), F.col("role").alias("r"), F.col("message_id").alias("m"), F.col("text").alias("t"))
    children = cut(best, "children")
    roots = own.where("(parent_id is null or parent_id = '') and text <> ''").select(F.col("message_id").alias("root_id"), F.col("message_id").alias("at"), "role", F.col("text").alias("content"), (F.col("role") != "system").cast("int").alias("n"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the walk ends by itself: n grows at each step
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(100, most + 2)))
    return holds(spark.sql(WALK, roots=roots, children=children, most=most), children)


def prompt_suite(df: DataFrame, strict: bool = True, strip=T.strip) -> DataFrame:
    """id, bucket, messages of a prompt table with text | (system, user) | messages and input position pos; bad entries are errors, or stay as they are if not strict. strip: takes white space off contents."""
    has = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    system, user = strip(F.coalesce(has("system", "string"), F.lit(""))), strip(F.coalesce(has("user", "string"), has("text", "string"), F.lit("")))
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    short = F.when(system != "", F.array(message("system", system), message("user", user))).otherwise(F.array(message("user", user)))
    given = F.transform(has("messages", MESSAGE), lambda m: F.struct(F.lower(T.strip(m["role"])).alias("role"), strip(m["content"]).alias("content")))
    out = df.withColumn("__m", F.coalesce(given, short))
    bad = F.lit(strict) & ((F.size("__m") == 0) | F.exists("__m", lambda m: ~m["role"].isin("system", "user", "assistant") | (m["content"] == "")))
    rest = [c for c in df.columns if c not in ("id", "bucket", "messages", "text", "system", "user", "pos")]
    return out.select(
        F.coalesce(has("id", "string"), F.format_string("prompt_%02d", F.col("pos") + 1)).alias("id"), F.coalesce(has("bucket", "string"), F.lit("general")).alias("bucket"),
        F.when(bad, F.raise_error(F.lit("invalid prompt entry"))).otherwise(F.col("__m")).alias("messages"), *rest,
    )


def tree_or_messages(df: DataFrame, most: int = 8, only: str | None = "en", version: str = "v7") -> DataFrame:
    """Normalised conversations of a table that has messages, else of message-tree rows."""
    return normalise(df if "messages" in df.columns else tree_paths(df, most, only), most=most, version=version)


def row_summary(df: DataFrame, block_size: int, n: int = 1024, order: str = "block_id") -> DataFrame:
    """One row about the first n rows of (input_ids, labels): median and nearest-rank p90 of lengths, supervised labels and first places.

    Rows whose arrays differ in length or exceed the block, and a table without any supervised label, are errors.
    """
    from tessera.operators.metrics import nearest_of_few

    active = F.filter(F.transform("labels", lambda x, i: F.when(x != fixed.IGNORED, i)), lambda i: i.isNotNull())
    fits = (F.size("input_ids") == F.size("labels")) & (F.size("input_ids") <= block_size)
    size = F.when(fits, F.size("input_ids")).otherwise(F.raise_error(F.lit("row with bad lengths")).cast("int"))
    own = df.orderBy(order).limit(n).select(size.alias("size"), F.size(active).alias("k"), F.try_element_at(active, F.lit(1)).alias("first"))
    k = F.when(F.col("k") > 0, F.col("k"))
    half = lambda c: F.floor(F.percentile(c, 0.5)).cast("int")
    out = own.agg(
        F.count("*").alias("rows_checked"), F.count(k).alias("supervised_rows"), half("size").alias("seq_len_p50"), nearest_of_few(F.col("size"), 0.9).alias("seq_len_p90"),
        half(k).alias("supervised_tokens_p50"), nearest_of_few(k, 0.9).alias("supervised_tokens_p90"), half("first").alias("first_supervised_p50"), nearest_of_few(F.col("first"), 0.9).alias("first_supervised_p90"),
    )
    return out.withColumn("supervised_rows", F.when(F.col("supervised_rows") > 0, F.col("supervised_rows")).otherwise(F.raise_error(F.lit("no supervised labels")).cast("long")))


def long_enough(ids: str = "input_ids", labels: str = "labels", least: int = 8) -> Column:
    return (F.size(ids) > least) & (F.size(labels) > least)
