"""Queries over documents and pages: partitioning, chunks, filters, extraction, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.plans import sql as S
from tessera.sources import texts

SALT, RATE, SHARDS, CHUNK, WRAP = "salt-v1", 0.1, 5, 2000, 0.3
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet")) if name in ("documents", "pages", "conversations") else spark.read.parquet(f"{d}/{name}.parquet")


#: A table of at most so many bytes is dealt to all cores if its files split into fewer parts.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small (SMALL) and its files split into fewer parts than there are cores: one small file would be one task."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    return df.repartition(cores) if int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SMALL and plan.toRdd().getNumPartitions() < cores else df


def ready(spark: SparkSession, d: str) -> DataFrame:
    """documents with the stripped text t, blank ones dropped."""
    return table(spark, d, "documents").withColumn("t", T.strip("text")).where("t <> ''")


READY = f"(SELECT *, {S.strip('text')} AS t FROM documents) WHERE t <> ''"
HOLD = S.ratio("source", "t", S.quote(SALT)) + f" < {RATE}"
BUCKET = f"least(floor({S.ratio('source', 't', S.quote(SALT), S.quote('shard'))} * {SHARDS})::INT, {SHARDS - 1})"


@query(f"SELECT doc_id, {HOLD} AS is_eval FROM {READY}")
def holdout_split(spark, d):
    return ready(spark, d).select("doc_id", T.in_holdout(F.col("source"), F.col("t"), SALT, RATE).alias("is_eval"))


@query(f"SELECT doc_id, {BUCKET} AS bucket FROM {READY}")
def shard_buckets(spark, d):
    return ready(spark, d).select("doc_id", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"))


@query(f"""WITH d AS (SELECT *, {HOLD} AS e, {BUCKET} AS bucket, {S.chunks('t', CHUNK)} AS c FROM {READY})
SELECT bucket, count(*) AS seen, count(*) FILTER (e) AS skipped_eval, count(*) FILTER (NOT e) AS accepted, count(*) FILTER (NOT e AND length(t) > {CHUNK}) AS chunked,
  coalesce(sum(len(c)) FILTER (NOT e), 0)::BIGINT AS chunks_emitted,
  coalesce(sum(len(list_filter(c, lambda x: {S.ratio('source', 'x', S.quote(SALT), S.quote('chatml'))} < {WRAP}))) FILTER (NOT e), 0)::BIGINT AS wrapped
FROM d GROUP BY bucket""")
def build_counters(spark, d):
    own = ready(spark, d).select("t", "source", T.in_holdout(F.col("source"), F.col("t"), SALT, RATE).alias("e"), T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"), T.text_chunks("t", CHUNK).alias("c"))
    train = ~F.col("e")
    wrapped = F.size(F.filter("c", lambda x: T.chat_wrapped(F.col("source"), x, SALT, WRAP)))
    number = lambda c: F.coalesce(F.sum(F.when(train, c)), F.lit(0)).cast("long")
    return own.groupBy("bucket").agg(
        F.count("*").alias("seen"), F.count_if("e").alias("skipped_eval"), F.count_if(train).alias("accepted"), F.count_if(train & (F.length("t") > CHUNK)).alias("chunked"),
        number(F.size("c")).alias("chunks_emitted"), number(wrapped).alias("wrapped"),
    )


HEAD = S.quote(f"{fixed.IM_START}user\n{fixed.CHATML_USER_PROMPT}{fixed.IM_END}\n{fixed.IM_START}assistant\n")


@query(f"""WITH c AS (SELECT doc_id, source, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS x FROM (SELECT *, {S.chunks('t', CHUNK)} AS c FROM {READY}) WHERE NOT {HOLD}),
w AS (SELECT *, {S.ratio('source', 'x', S.quote(SALT), S.quote('chatml'))} < {WRAP} AS wrapped FROM c)
SELECT doc_id, chunk_no::INT AS chunk_no, wrapped, length(x) AS n_chars, md5(CASE WHEN wrapped THEN {HEAD} || x || {S.quote(fixed.IM_END)} ELSE x END) AS digest FROM w""")
def chatml_slice(spark, d):
    own = ready(spark, d).where(~T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", "source", F.posexplode(T.text_chunks("t", CHUNK)).alias("chunk_no", "x"))
    own = own.withColumn("wrapped", T.chat_wrapped(F.col("source"), F.col("x"), SALT, WRAP))
    return own.select("doc_id", "chunk_no", "wrapped", F.length("x").alias("n_chars"), F.md5(F.when(F.col("wrapped"), T.chatml_wrap("x")).otherwise(F.col("x"))).alias("digest"))


@query(f"""SELECT doc_id, len(c) AS chunks, length(t) AS n_chars, md5(array_to_string(c, chr(1))) AS digest FROM (SELECT *, {S.chunks('t', 500)} AS c FROM {READY})""")
def text_chunks(spark, d):
    own = ready(spark, d).select("doc_id", "t", T.text_chunks("t", 500).alias("c"))
    return own.select("doc_id", F.size("c").alias("chunks"), F.length("t").alias("n_chars"), F.md5(F.array_join("c", "\u0001")).alias("digest"))


MESSY = "(CASE WHEN doc_id % 3 = 0 THEN chr(8195) || chr(160) || replace(text, ' ', '    ') || chr(9) || chr(28) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) || repeat(chr(10), 6) || 'x' ELSE text END)"


def messy() -> Column:
    text, k = F.col("text"), F.col("doc_id") % 3
    first = F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("    ")), F.lit("\t\u001c"))
    second = F.concat(F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit("\n" * 6 + "x"))
    return F.when(k == 0, first).when(k == 1, second).otherwise(text)


@query(f"""SELECT doc_id, md5({S.strip("regexp_replace(regexp_replace(replace(m, chr(13) || chr(10), chr(10)), '[ \\t]{3,}', '  ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')")}) AS digest,
  length({S.strip('m')}) AS stripped FROM (SELECT doc_id, {MESSY} AS m FROM documents)""")
def normalize_text(spark, d):
    own = table(spark, d, "documents").select("doc_id", messy().alias("m"))
    return own.select("doc_id", F.md5(T.normalise_light("m")).alias("digest"), F.length(T.strip("m")).alias("stripped"))


LISTED = "(CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(10) || '- ') WHEN doc_id % 4 = 1 THEN replace(text, chr(10), chr(10) || '  12) ') ELSE text END)"
STOP = "[" + ", ".join(map(S.quote, fixed.TOPIC_STOP_WORDS)) + "]"


@query(f"""SELECT doc_id, len(w) AS n_words, len(regexp_extract_all(x, '(?m)^\\s*(?:[-*]|\\d+[.)])\\s+')) AS items,
  round(CASE WHEN len(w) < 12 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({S.grams('w')} - 0.45) / 0.45)) END, 9) AS repetition,
  md5(array_to_string(list_sort(list_distinct(list_filter(w, lambda q: length(q) > 4 AND NOT list_contains({STOP}, q)))), ' ')) AS topics
FROM (SELECT doc_id, x, {S.lower_words('x')} AS w FROM (SELECT doc_id, {LISTED} AS x FROM documents))""")
def text_measures(spark, d):
    k = F.col("doc_id") % 4
    x = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\n- "))).when(k == 1, F.replace("text", F.lit("\n"), F.lit("\n  12) "))).otherwise(F.col("text"))
    own = table(spark, d, "documents").select("doc_id", x.alias("x"))
    return own.select(
        "doc_id", T.word_count("x").alias("n_words"), T.list_items("x").alias("items"), F.round(T.repetition_score("x"), 9).alias("repetition"), F.md5(F.array_join(T.topic_words("x"), " ")).alias("topics")
    )


#: One text for each rule of the filters; they are set before documents, as the tables trip few of the rules.
PROBES = [
    "```x```", "import os.path", "from a.b import c", "def foo (x)", "class Foo", "public class X", "console.log (x)", "see <script src>", "#include <x>", "select a, b from c", "function f (x)", "return {", "Traceback (last)",
    "an Exception", "{}[]();<>{}[]();<>", '"key name" : 3', "[NAME] and [PLACE]", "Dear friend,", "I hope this message finds you well.", "https://x.y", "WWW.x.y", "no no no no no no", "write a script", "stack trace", "api for the endpoint",
]
PROBED = "(CASE doc_id % 40 " + " ".join(f"WHEN {i} THEN {S.quote(p)} || ' ' || text" for i, p in enumerate(PROBES)) + " WHEN 30 THEN '{' || text || '}' WHEN 31 THEN '[' || text || ']' WHEN 32 THEN text || chr(10) || text || chr(10) || text || chr(10) || text ELSE text END)"


def probed() -> Column:
    k = F.col("doc_id") % 40
    probes = F.array(*map(F.lit, PROBES))
    text = F.col("text")
    out = F.when(k < len(PROBES), F.concat(F.get(probes, k.cast("int")), F.lit(" "), text))
    return out.when(k == 30, F.concat(F.lit("{"), text, F.lit("}"))).when(k == 31, F.concat(F.lit("["), text, F.lit("]"))).when(k == 32, F.concat_ws("\n", text, text, text, text)).otherwise(text)


def filter_columns(x: str) -> list[Column]:
    return [
        *T.filter_flags(x), T.programming_request(x).alias("is_request"),
    ]


@query(f"""WITH f AS ({S.flags(f"(SELECT doc_id, {PROBED} AS x FROM documents)", 'doc_id', 'x')}) SELECT *, {S.usable(200)} AS usable_v7, {S.usable(140)} AS usable_v5 FROM f""")
def filter_flags(spark, d):
    own = table(spark, d, "documents").select("doc_id", probed().alias("x"))
    return own.select("doc_id", *filter_columns("x")).withColumns({"usable_v7": T.usable_flags(200), "usable_v5": T.usable_flags(140)})


@query(f"""WITH f AS ({S.flags('pages', 'page_id', 'html')}) SELECT * FROM f""")
def filter_flags_pages(spark, d):
    return table(spark, d, "pages").select("page_id", *filter_columns("html"))


@query(f"""WITH t AS (SELECT page_id, list_filter([url, html], lambda x: {S.strip('x')} <> '') AS l FROM pages)
SELECT page_id, unnest(range(0, len(l)))::INT AS text_no, md5(unnest(l)) AS digest FROM t""")
def extract_texts_star(spark, d):
    out = texts(table(spark, d, "pages"), ["*"])
    return out.select("page_id", "text_no", F.md5("text").alias("digest"))


@query(f"""SELECT doc_id, 0 AS text_no, md5(text) AS digest FROM documents WHERE {S.strip('text')} <> ''
UNION ALL SELECT -1 - page_id, 0, md5(html) FROM pages WHERE {S.strip('html')} <> ''""")
def extract_texts_fields(spark, d):
    first = texts(table(spark, d, "documents")).select("doc_id", "text_no", F.md5("text").alias("digest"))
    second = texts(table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.array("html").alias("body")), ["missing", "body"])
    return first.unionAll(second.select("doc_id", "text_no", F.md5("text").alias("digest")))


@query(f"SELECT page_id, md5({S.strip('url')}) AS single, md5({S.strip('html')}) AS first FROM pages")
def first_texts(spark, d):
    df = table(spark, d, "pages")
    kinds = dict(df.dtypes)
    return df.select("page_id", F.md5(T.single_text(kinds)).alias("single"), F.md5(T.first_text(kinds, ["body", "html"])).alias("first"))


SLUGS = list(fixed.SOURCE_SLUGS)


@query(f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 < {len(SLUGS)} THEN [{', '.join(map(S.quote, SLUGS))}][doc_id % 9 + 1] ELSE 'org/new-data.' || source END AS n, CASE WHEN doc_id % 2 = 0 THEN 'cfg' WHEN doc_id % 3 = 0 THEN '' END AS c FROM documents)
SELECT doc_id, CASE WHEN coalesce(c, '') <> '' THEN n || '[' || c || ']' ELSE n END AS name,
  CASE {' '.join(f'WHEN n = {S.quote(k)} THEN {S.quote(v)}' for k, v in fixed.SOURCE_SLUGS.items())} ELSE translate(string_split(n, '/')[-1], '-.', '__') END AS slug FROM s""")
def source_names(spark, d):
    k = F.col("doc_id") % 9
    name = F.when(k < len(SLUGS), F.get(F.array(*map(F.lit, SLUGS)), k.cast("int"))).otherwise(F.concat(F.lit("org/new-data."), F.col("source")))
    config = F.when(F.col("doc_id") % 2 == 0, "cfg").when(F.col("doc_id") % 3 == 0, "")
    own = table(spark, d, "documents").select("doc_id", name.alias("n"), config.alias("c"))
    return own.select("doc_id", T.source_name("n", "c").alias("name"), T.source_slug("n").alias("slug"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS fp FROM documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint("text").alias("fp"))


@query("""WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark)
SELECT item_id, substr(sha256(unhex(array_to_string(list_transform(range(0, length(h) // 2), lambda i: format('{:02x}{:02x}', (('0x' || substr(h, i * 2 + 1, 2))::INT + 4) & 255, (('0x' || substr(h, i * 2 + 1, 2))::INT + 4) >> 8)), ''))), 1, 32) AS fp FROM b""")
def block_fingerprints(spark, d):
    from tessera.operators.chat import text_ids

    return table(spark, d, "benchmark").select("item_id", T.block_fingerprint(text_ids(F.col("text"))).alias("fp"))


@query("""SELECT event_id, round(ln(CASE WHEN value < 30 THEN exp(value) ELSE 'inf'::DOUBLE END), 6) AS log_ppl,
  CASE event_id % 5 WHEN 0 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS class,
  CASE event_id % 5 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN event_id * 1000000000 WHEN 2 THEN event_id * 1048576 WHEN 3 THEN event_id * 1000000000 + 500000000 ELSE 0 END AS tokens,
  round(CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE value END, 6) AS metric, CASE WHEN event_id % 2 = 0 THEN format('{:.4f}', event_id / 8) ELSE '' END AS shown FROM events""")
def report_values(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % 5
    name = F.when(k == 0, F.lit("final")).when(k == 1, F.concat(F.lit("checkpoint-"), e, F.lit("B-tokens"))).when(k == 2, F.concat(F.lit("checkpoint-"), e)).when(k == 3, F.concat(F.lit("checkpoint-"), e, F.lit(".5B-tokens"))).otherwise("other")
    own = table(spark, d, "events").withColumn("key", T.checkpoint_key(name))
    m = F.when(e % 3 == 0, F.create_map(F.lit("acc,none"), F.lit(0.1), F.lit("acc_norm,none"), F.lit(0.5))).when(e % 3 == 1, F.create_map(F.lit("x"), F.lit(0.9), F.lit("exact_match,none"), F.lit(0.25))).otherwise(F.create_map(F.lit("y"), F.col("value")))
    return own.select("event_id", T.half_away(T.log(T.perplexity("value")), 6).alias("log_ppl"), "key.class", "key.tokens", T.half_away(T.metric_value(m), 6).alias("metric"), T.four_digits(F.when(e % 2 == 0, e / 8)).alias("shown"))
