"""Queries over what builds write and stream: packed shards, blocks of a stream, staged tables, counters of the pass, sketches, instruction rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import text as T
from tessera.operators import audit, chat, instruct, pack, sketches, tokens
from tessera.plans import build, staging
from tessera.plans import sql as S
from tessera.plans.catalog_mix import TRAIN, blocks_sql, shown
from tessera.plans.catalog_text import BUCKET, CHUNK, HOLD, RATE, READY, SALT, SHARDS, WRAP, ready, table
from tessera.plans.lineage import _file_system, shared_dir
from tessera.sources import packed, sinks
from tessera.streaming import packing

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def place(spark, name: str) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def train_texts(spark, d) -> DataFrame:
    return ready(spark, d).where(~T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"), F.col("t").alias("text"))


BLOCKS = blocks_sql(TRAIN, "bucket", "doc_id", 512)


# --- packed shards and streams --------------------------------------------------------------------------------------------


@query(f"SELECT bucket AS shard_id, block_id, 512 AS n, md5(h) AS digest FROM ({BLOCKS})")
def packed_shards(spark, d):
    """All blocks, written as packed shards of Arrow files and read back."""
    out = place(spark, "packed")
    blocks = pack.blocks(tokens.byte_ids(train_texts(spark, d)), ["bucket"], "doc_id", 512)
    packed.write_packed(blocks.withColumnRenamed("bucket", "shard_id"), out, block_size=512)
    return packed.read_packed(spark, out).select("shard_id", "block_id", F.size("input_ids").alias("n"), F.md5(shown("input_ids")).alias("digest"))


@query(f"SELECT bucket AS shard_id, count(*) AS blocks, count(*) * 512 AS tokens, true AS complete FROM ({BLOCKS}) WHERE bucket BETWEEN 1 AND 3 GROUP BY bucket")
def packed_some(spark, d):
    """Counts of some packed shards, of which the filter chooses the folders; a shard without its state is passed over."""
    out = place(spark, "packed")
    blocks = pack.blocks(tokens.byte_ids(train_texts(spark, d)), ["bucket"], "doc_id", 512)
    packed.write_packed(blocks.withColumnRenamed("bucket", "shard_id").where("shard_id <= 3"), out, block_size=512)
    fs, root = packed._opened(out)
    fs.delete_file(f"{root}/shard-000/{packed.STATE}")
    got = packed.read_packed(spark, out, strict=False).where("shard_id between 0 and 3")
    return got.groupBy("shard_id").agg(F.count("*").alias("blocks"), F.sum(F.size("input_ids").cast("long")).alias("tokens"), F.bool_and(F.size("labels") == 512).alias("complete"))


@query(f"SELECT bucket, block_id, md5(h) AS digest FROM ({BLOCKS})")
def stream_pack(spark, d):
    """The blocks of a stream: texts arrive in three parts; the query packs each behind the remainder of the one before, started anew each time."""
    inbox, out, state = place(spark, "inbox"), place(spark, "blocks"), place(spark, "state")
    texts = train_texts(spark, d)
    low, high = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
    for k in range(3):
        share = (F.lit(3) * (F.col("doc_id") - (low or 0)) / ((high or 0) - (low or 0) + 1)).cast("int")
        texts.where(share == k).write.mode("append").parquet(inbox)
        schema = ", ".join(f"{n} {t}" for n, t in texts.dtypes)
        packing.pack_arriving(spark, tokens.byte_ids, inbox, schema, out, state, "bucket", "doc_id", 512, files_per_trigger=None).awaitTermination()
    return packing.packed_blocks(spark, out).select("bucket", "block_id", F.md5(shown("input_ids")).alias("digest"))


# --- staged tables and builds ----------------------------------------------------------------------------------------------


@query(f"SELECT source, {BUCKET} AS shard_id, count(*) AS total, count(DISTINCT t) AS distinct_n, round(count(*)::DOUBLE / count(DISTINCT t), 9) AS factor FROM {READY} GROUP BY source, {BUCKET}")
def staged_duplicates(spark, d):
    """Duplicates by source and shard from a bucketed table: no exchange after the staging."""
    own = ready(spark, d).select("doc_id", "source", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("shard_id"), F.col("t").alias("text"))
    name = f"staged_{uuid.uuid4().hex}"
    staged = staging.stage_table(own, name, place(spark, "staged"), 16, ["doc_id"])
    return staging.duplicates(staged).withColumn("factor", F.round("factor", 9))


@query(f"SELECT doc_id, source, {BUCKET} AS shard_id, coalesce(sum(length(t)) OVER (PARTITION BY source, {BUCKET} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"from\" FROM {READY}")
def staged_offsets(spark, d):
    own = ready(spark, d).select("doc_id", "source", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("shard_id"), F.length("t").alias("n"))
    staged = staging.stage_table(own, f"staged_{uuid.uuid4().hex}", place(spark, "staged"), 16, ["doc_id"])
    return staging.offsets(staged, "doc_id", "n").select("doc_id", "source", "shard_id", "from")


@query(f"""WITH d AS (SELECT *, {HOLD.replace('source', "'docs'")} AS e, {S.chunks('t', CHUNK)} AS c FROM {READY})
SELECT 'docs' AS source, count(*) AS seen, count(*) FILTER (NOT e) AS accepted, count(*) FILTER (e) AS skipped, coalesce(sum(len(c)) FILTER (NOT e), 0)::BIGINT AS chunks, count(*) FILTER (NOT e AND length(t) > {CHUNK}) AS chunked,
  coalesce(sum(len(list_filter(c, lambda x: {S.ratio("'docs'", 'x', S.quote(SALT), S.quote('chatml'))} < {WRAP}))) FILTER (NOT e), 0)::BIGINT AS wrapped FROM d""")
def build_pass_counters(spark, d):
    """A build of shards from documents, and what the pass that prepared them counted on the way."""
    out = place(spark, "build")
    own = sources.Source("docs", f"{d}/documents.parquet", text_fields=["text"], holdout_rate=RATE, holdout_salt=SALT, chatml_wrap_rate=WRAP, long_text_chunk_chars=CHUNK)
    build.build(spark, sources.BuildConfig([own], seed=3, num_shards=2, block_size=256, shard_tokens=20_000), out)
    meta = spark.read.text(f"{out}/meta", wholetext=True)
    rows = meta.select(F.explode(F.from_json("value", "sources array<struct<source:string,seen:long,accepted:long,skipped:long,chunks:long,chunked:long,wrapped:long>>")["sources"]).alias("s"))
    return rows.select("s.*")


@query("SELECT md5(text) AS digest, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def jsonl_texts(spark, d):
    """Texts of JSON lines with sorted keys, some of them malformed, all string values of each."""
    out = place(spark, "lines")
    docs = table(spark, d, "documents")
    sinks.write_jsonl(docs.select("text", "source", "doc_id"), out)
    docs.select(F.concat(F.lit('{"text": "cut off '), F.col("doc_id").cast("string")).alias("value")).write.mode("append").text(out)
    got = sources.lenient_json_texts(spark, out)
    return got.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


# --- sketches --------------------------------------------------------------------------------------------------------------

PARTS = f"(SELECT *, {BUCKET} AS shard FROM {READY})"


def parts(spark, d) -> DataFrame:
    return ready(spark, d).select("source", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("shard"), F.col("t").alias("text"))


@query(f"SELECT source, count(*) AS total, count(DISTINCT t) AS distinct_n, true AS distinct_within, true AS lengths_within FROM {PARTS} GROUP BY source")
def sketch_audit(spark, d):
    """Exact duplicates by source, and whether the estimates of merged sketches lie within four standard errors of them."""
    own = parts(spark, d)
    exact = audit.per_source(own).select("source", "total", "distinct_n")
    lengths = own.groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("k"))
    est = sketches.audit(sketches.stored(own)).select("source", F.col("distinct_n").alias("estimate"), F.posexplode("lengths").alias("q", "x"))
    ranks = est.join(lengths, "source").groupBy("source", "q", "x", "estimate").agg(F.sum(F.when(F.col("n") < F.col("x"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("n") <= F.col("x"), F.col("k")).otherwise(0)).alias("upto"), F.sum("k").alias("all"))
    want = F.get(F.array(*map(F.lit, (0.5, 0.9, 0.99))), F.col("q"))
    error = F.greatest(F.col("below") / F.col("all") - want, want - F.col("upto") / F.col("all"))
    within = ranks.groupBy("source").agg(F.first("estimate").alias("estimate"), F.bool_and(error <= 4 * sketches.RANK_ERROR).alias("lengths_within"))
    return exact.join(within, "source").select("source", "total", "distinct_n", (F.abs(F.col("estimate") - F.col("distinct_n")) <= 4 * sketches.DISTINCT_ERROR * F.col("distinct_n") + 1).alias("distinct_within"), "lengths_within")


@query(f"""WITH f AS (SELECT source, t, min(shard) AS shard FROM {PARTS} GROUP BY source, t), n AS (SELECT shard, count(*) AS new FROM f GROUP BY shard), a AS (SELECT shard, count(*) AS n FROM {PARTS} GROUP BY shard)
SELECT shard, sum(n) OVER (ORDER BY shard)::BIGINT AS total, sum(coalesce(new, 0)) OVER (ORDER BY shard)::BIGINT AS distinct_n, true AS within FROM a LEFT JOIN n USING (shard)""")
def sketch_running(spark, d):
    """Running totals after each shard, exact and from stored sketches."""
    own = parts(spark, d)
    exact = audit.running(own).select("shard", "total", "distinct_n")
    est = sketches.running(sketches.stored(own)).select("shard", F.col("distinct_n").alias("estimate"))
    return exact.join(est, "shard").select("shard", "total", "distinct_n", (F.abs(F.col("estimate") - F.col("distinct_n")) <= 4 * sketches.DISTINCT_ERROR * F.col("distinct_n") + 1).alias("within"))


# --- instruction rows --------------------------------------------------------------------------------------------------------

EXAMPLES = f"""x AS (SELECT doc_id, '### Instruction:' || chr(10) || {S.strip("coalesce(substr(text, 1, 40), '')")} || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '### Input:' || chr(10) || source || chr(10) || chr(10) ELSE '' END || '### Response:' || chr(10) AS p,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE {S.strip("substr(text, 41)")} END AS o FROM documents),
y AS (SELECT doc_id, lower(hex(encode(p || o))) AS w, octet_length(encode(p)) AS n FROM x),
r AS (SELECT doc_id, substr(w, 1, 1024) || CASE WHEN length(w) < 1024 THEN '$$' ELSE '' END AS ids, substr(repeat('--', n::INT) || substr(w, 2 * n + 1), 1, 1024) || CASE WHEN length(w) < 1024 THEN '$$' ELSE '' END AS labels FROM y)"""


def examples(spark, d) -> DataFrame:
    text, k = F.col("text"), F.col("doc_id")
    own = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("instruction"), F.when(k % 3 == 0, F.col("source")).alias("input"), F.when(k % 11 == 0, "").otherwise(text.substr(F.lit(41), F.length("text"))).alias("output"))
    return instruct.instruction_rows(own, 512)


@query(f"WITH {EXAMPLES} SELECT doc_id, length(ids) // 2 AS n, md5(ids) AS ids, md5(labels) AS labels FROM r WHERE length(ids) > 16")
def instruction_rows(spark, d):
    return examples(spark, d).select("doc_id", F.size("input_ids").cast("long").alias("n"), F.md5(shown("input_ids")).alias("ids"), F.md5(shown("labels")).alias("labels"))


@query(f"""WITH {EXAMPLES}, f AS (SELECT length(ids) // 2 AS size, (length(labels) - length(replace(labels, '-', ''))) // 2 AS first FROM r WHERE length(ids) > 16 ORDER BY doc_id LIMIT 1024),
q AS (SELECT size, CASE WHEN first < size THEN first END AS first, nullif(size - first, 0) AS k FROM f),
l AS (SELECT count(*) AS rows_checked, count(k) AS supervised_rows, floor(median(size))::INT AS seq_len_p50, list_sort(list(size)) AS s, floor(median(k))::INT AS supervised_tokens_p50, list_sort(list(k) FILTER (k IS NOT NULL)) AS ks, floor(median(first))::INT AS first_supervised_p50, list_sort(list(first) FILTER (first IS NOT NULL)) AS fs FROM q)
SELECT rows_checked, supervised_rows, seq_len_p50, s[round_even((len(s) - 1) * 0.9, 0)::INT + 1]::INT AS seq_len_p90, supervised_tokens_p50, ks[round_even((len(ks) - 1) * 0.9, 0)::INT + 1]::INT AS supervised_tokens_p90, first_supervised_p50, fs[round_even((len(fs) - 1) * 0.9, 0)::INT + 1]::INT AS first_supervised_p90 FROM l""")
def instruction_summary(spark, d):
    return chat.row_summary(examples(spark, d), 512, order="doc_id")
