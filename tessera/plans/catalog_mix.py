"""Queries: mixing, sampling, tokens, packing, evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.operators import mix, pack, tokens
from tessera.operators.metrics import exclusive, linear, quantiles
from tessera.plans import sql as S
from tessera.plans.catalog_text import RATE, READY, SALT, SHARDS, BUCKET, HOLD, ready, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


WEIGHTS = {f"src{i}": 1.0 + i % 5 for i in range(20)}
GAP = f"-ln({S.ratio(S.quote('17'), 'source', 'pos::VARCHAR')} * 0.999999::DOUBLE + 5e-7) / (1.0 + (substr(source, 4)::INT % 5))"
MIXED = f"""g AS (SELECT *, {GAP} AS gap FROM base), a AS (SELECT *, sum(gap) OVER (PARTITION BY source ORDER BY pos) AS arrival FROM g),
m AS (SELECT *, row_number() OVER (ORDER BY arrival, source, pos) - 1 AS mix_pos FROM a)"""


def stream(spark, d):
    """documents as streams: the place in a source is the document's id."""
    return table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").alias("pos"))


@query(f"WITH base AS (SELECT doc_id, source, doc_id AS pos FROM documents), {MIXED} SELECT doc_id, source, mix_pos FROM m")
def mix_order(spark, d):
    return mix.mix(stream(spark, d), WEIGHTS, 17).select("doc_id", "source", "mix_pos")


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents),
base AS (SELECT doc_id, source, epoch, rn + epoch * n AS pos FROM s, unnest([0, 1]) AS e(epoch)), {MIXED} SELECT doc_id, epoch, mix_pos FROM m""")
def mix_restart(spark, d):
    from pyspark.sql import Window

    own = table(spark, d, "documents").select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("pos"))
    return mix.mix_restart(own, WEIGHTS, 2, 17).select("doc_id", "epoch", "mix_pos")


@query(f"""WITH base AS (SELECT doc_id, source, doc_id AS pos FROM documents), {MIXED}, l AS (SELECT max(mix_pos) AS last FROM m GROUP BY source)
SELECT doc_id, mix_pos FROM m WHERE mix_pos <= (SELECT min(last) FROM l)""")
def mix_first_exhausted(spark, d):
    return mix.mix_first_exhausted(stream(spark, d), WEIGHTS, 17).select("doc_id", "mix_pos")


@query(f"WITH base AS (SELECT doc_id, source, doc_id AS pos FROM documents), g AS (SELECT *, -ln({S.ratio(S.quote('5'), 'source', 'pos::VARCHAR')} * 0.999999::DOUBLE + 5e-7) AS gap FROM base), a AS (SELECT *, sum(gap) OVER (PARTITION BY source ORDER BY pos) AS arrival FROM g) SELECT doc_id, row_number() OVER (ORDER BY arrival, source, pos) - 1 AS mix_pos FROM a")
def mix_uniform(spark, d):
    return mix.mix(stream(spark, d), dict.fromkeys(WEIGHTS, 1.0), 5).select("doc_id", "mix_pos")


KEY = "sha256('9' || chr(0) || doc_id::VARCHAR)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {KEY}, doc_id)::INT AS place FROM documents")
def shuffle_order(spark, d):
    """The place of each row in a full shuffle: ranks of the first bits of the hash, ties by the whole."""
    own = table(spark, d, "documents").select("doc_id", mix.shuffle_key(9, "doc_id").alias("k"))
    from tessera.plans.prefix import global_rank

    own = own.withColumn("o", F.conv(F.substring("k", 1, 13), 16, 10).cast("double"))
    return global_rank(own, "o", ["k", "doc_id"], "place").select("doc_id", (F.col("place") + 1).cast("int").alias("place"))


@query(f"SELECT doc_id, {S.ratio(S.quote('3'), 'doc_id::VARCHAR')} < 0.2 AS is_test FROM documents")
def random_split(spark, d):
    train, test = mix.split(table(spark, d, "documents"), 0.2, 3, "doc_id")
    return test.select("doc_id", F.lit(True).alias("is_test")).unionAll(train.select("doc_id", F.lit(False).alias("is_test")))


@query(f"SELECT doc_id FROM documents WHERE {S.strip('text')} <> '' ORDER BY sha256('4' || chr(0) || doc_id::VARCHAR), doc_id LIMIT 50")
def first_filled_rows(spark, d):
    return mix.first_filled_rows(table(spark, d, "documents"), 50, 4, "text", "doc_id").select("doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents), p AS (SELECT DISTINCT floor(i * (n / 97.0::DOUBLE))::BIGINT AS rn FROM range(97) AS t(i), (SELECT max(n) AS n FROM r))
SELECT doc_id FROM r JOIN p USING (rn)""")
def even_sample(spark, d):
    return mix.even_sample(table(spark, d, "documents"), 97, "doc_id").select("doc_id")


@query("SELECT avg(length(text))::DOUBLE AS mean_chars, (sum(length(text)) / 4.0)::DOUBLE AS tokens FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100)")
def head_sample(spark, d):
    own = mix.head(table(spark, d, "documents"), 100, "doc_id")
    return own.agg(F.avg(F.length("text")).alias("mean_chars"), F.sum(tokens.estimated_tokens("text")).alias("tokens"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def top_per_source(spark, d):
    return mix.top_per_group(table(spark, d, "documents"), 3, "source", F.desc(F.length("text")), "doc_id").select("source", "doc_id")


# --- tokens; an oracle writes a byte token as two hex digits, BOS as ^^ and EOS as $$ -----------------------------------


def shown(ids) :
    cell = lambda x: F.when(x == fixed.BOS, "^^").when(x == fixed.EOS, "$$").when(x < 0, "--").otherwise(F.lower(F.lpad(F.hex(x - fixed.BYTE_SHIFT), 2, "0")))
    return F.array_join(F.transform(ids, cell), "")


TOKENS = f"(SELECT *, '^^' || lower(hex(encode(t))) || '$$' AS h FROM {READY})"


@query(f"SELECT doc_id, length(h) // 2 AS n_tokens, md5(h) AS digest, ceil(length(t) / 4.0)::BIGINT AS estimate, length(h) // 2 + 64 <= 1024 AS fits FROM {TOKENS}")
def byte_tokens(spark, d):
    own = tokens.byte_ids(ready(spark, d).select("doc_id", F.col("t").alias("text"), F.length("t").alias("n")))
    return own.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(shown("ids")).alias("digest"), F.ceil(F.col("n") / 4.0).alias("estimate"), T.within_context(F.size("ids"), F.lit(64), 1024).alias("fits"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lower(hex(encode(text))) END AS h FROM documents)
SELECT doc_id, length(h) // 2 + 1 AS with_eos, CASE WHEN h = '' THEN 0 ELSE length(h) // 2 + 1 END AS eos_if_any, md5(substr(h || '$$', 1, 128) || repeat('$$', greatest(0, 64 - length(h) // 2 - 1))) AS cut_digest,
 least(64, length(h) // 2 + 1) AS live FROM t""")
def token_variants(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"))
    # strip would change the few texts with outer white space: the bytes are taken as they are
    from tessera.operators.chat import text_ids

    own = own.select("doc_id", text_ids(F.col("text")).alias("ids"))
    own = own.withColumn("e", tokens.with_eos("ids"))
    return own.select(
        "doc_id", F.size("e").cast("long").alias("with_eos"), F.size(tokens.with_eos("ids", empty_too=False)).cast("long").alias("eos_if_any"), F.md5(shown(tokens.fit("e", 64, fixed.EOS))).alias("cut_digest"),
        F.aggregate(tokens.mask("e", 64), F.lit(0), lambda a, x: a + x).cast("long").alias("live"),
    )


def blocks_sql(base: str, keys: str, order: str, size: int, tail: str = "drop") -> str:
    """Segment form: each document's part of each block that it touches. base: a relation with h, the written tokens."""
    part = f"PARTITION BY {keys} " if keys else ""
    pick = f"{keys}, " if keys else ""
    end = f"WHERE length(h) = {2 * size}" if tail == "drop" else ""
    return f"""WITH o AS (SELECT *, length(h) // 2 AS n, coalesce(sum(length(h) // 2) OVER ({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM {base}),
e AS (SELECT *, unnest(range(off // {size}, (off + n - 1) // {size} + 1)) AS block_id FROM o),
p AS (SELECT {pick}block_id, off, substr(h, (greatest(block_id * {size} - off, 0) * 2 + 1)::BIGINT, ((least((block_id + 1) * {size} - off, n) - greatest(block_id * {size} - off, 0)) * 2)::BIGINT) AS piece FROM e),
b AS (SELECT {pick}block_id, string_agg(piece, '' ORDER BY off) AS h FROM p GROUP BY {pick}block_id)
SELECT {pick}block_id, h FROM b {end}"""


TRAIN = f"(SELECT *, {BUCKET} AS bucket FROM {TOKENS} WHERE NOT {HOLD})"


@query(f"SELECT bucket, block_id, 1024 AS n, md5(h) AS digest FROM ({blocks_sql(TRAIN, 'bucket', 'doc_id', 1024)})")
def pack_blocks(spark, d):
    own = ready(spark, d).where(~T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"), F.col("t").alias("text"))
    out = pack.blocks(tokens.byte_ids(own), ["bucket"], "doc_id", 1024)
    return out.select("bucket", "block_id", F.size("input_ids").alias("n"), F.md5(shown("input_ids")).alias("digest"))


@query(f"SELECT bucket, count(*) AS blocks, sum(n)::BIGINT AS tokens FROM (SELECT bucket, 256 AS n FROM ({blocks_sql(TRAIN, 'bucket', 'doc_id', 256)}) WHERE block_id < {-(-20_000 // 256)}) GROUP BY bucket")
def token_budget(spark, d):
    own = ready(spark, d).where(~T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", T.shard_bucket(F.col("source"), F.col("t"), SALT, SHARDS).alias("bucket"), F.col("t").alias("text"))
    out = mix.token_budget(pack.blocks(tokens.byte_ids(own), ["bucket"], "doc_id", 256), 20_000, 256)
    return pack.block_stats(out, ["bucket"]).withColumn("tokens", F.col("tokens").cast("long"))


CANARY = f"(SELECT item_id, '^^' || lower(hex(encode({S.strip('text')}))) || '$$' AS h FROM benchmark WHERE {S.strip('text')} <> '')"


@query(f"SELECT block_id, length(h) // 2 AS live, md5(h || repeat('$$', 128 - length(h) // 2)) AS ids, md5(h || repeat('--', 128 - length(h) // 2)) AS labels FROM ({blocks_sql(CANARY, '', 'item_id', 128, 'pad')})")
def pack_padded(spark, d):
    out = pack.blocks(tokens.byte_ids(table(spark, d, "benchmark")), [], "item_id", 128, tail="pad")
    live = F.size(F.filter("attention_mask", lambda x: x == 1)).cast("long")
    return out.select("block_id", live.alias("live"), F.md5(shown("input_ids")).alias("ids"), F.md5(shown("labels")).alias("labels"))


@query(f"""WITH d AS (SELECT *, doc_id // 100 AS batch FROM {TOKENS}), t AS (SELECT batch, sum(length(h) // 2) AS total FROM d GROUP BY batch)
SELECT b.batch, block_id, md5(h) AS digest FROM ({blocks_sql('d', 'batch', 'doc_id', 512)}) b JOIN t ON b.batch = t.batch WHERE block_id < ceil(total / 512) - 1""")
def pack_batch_local(spark, d):
    own = tokens.byte_ids(ready(spark, d).select("doc_id", F.col("t").alias("text")))
    return pack.batch_blocks(own, "doc_id", 100, 512).select("batch", "block_id", F.md5(shown("input_ids")).alias("digest"))


@query("""WITH b AS (SELECT doc_id, doc_id // 16 AS batch, lower(hex(encode(text))) AS h FROM documents), m AS (SELECT *, least(max(length(h) // 2) OVER (PARTITION BY batch), 300) AS w FROM b)
SELECT doc_id, w AS width, least(length(h) // 2, w) AS live, md5(substr(h, 1, w * 2) || repeat('$$', greatest(0, w - length(h) // 2))) AS digest FROM m""")
def pad_batches(spark, d):
    from tessera.operators.chat import text_ids

    own = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), text_ids(F.col("text")).alias("ids"))
    out = pack.pad_batches(own, "batch", most=300)
    live = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", F.size("input_ids").cast("long").alias("width"), live.cast("long").alias("live"), F.md5(shown("input_ids")).alias("digest"))


HELD = f"(SELECT * FROM {TOKENS} WHERE {HOLD})"


@query(f"SELECT source, block_id, md5(h) AS digest FROM ({blocks_sql(HELD, 'source', 'doc_id', 256)}) WHERE block_id < {-(-2_000 // 256)}")
def eval_by_source(spark, d):
    """A held-out set for each source, each with its own token budget, in one pass over all sources."""
    own = ready(spark, d).where(T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", "source", F.col("t").alias("text"))
    out = mix.token_budget(pack.blocks(tokens.byte_ids(own), ["source"], "doc_id", 256), 2_000, 256)
    return out.select("source", "block_id", F.md5(shown("input_ids")).alias("digest"))


@query(f"""WITH p AS ({blocks_sql(HELD, 'source', 'doc_id', 256)}), a AS (SELECT source AS subset, 1 AS n FROM p UNION ALL SELECT 'canary', 1 FROM ({blocks_sql(CANARY, '', 'item_id', 256, 'pad')}) UNION ALL SELECT 'all', 1 FROM p)
SELECT subset, count(*) AS blocks, CASE WHEN subset = 'all' THEN 1 ELSE 0 END AS last FROM a GROUP BY subset""")
def eval_suite(spark, d):
    """Blocks of every subset: one for each source, the canary set, and last all sources together."""
    own = ready(spark, d).where(T.in_holdout(F.col("source"), F.col("t"), SALT, RATE)).select("doc_id", "source", F.col("t").alias("text"))
    by = pack.blocks(tokens.byte_ids(own), ["source"], "doc_id", 256).select(F.col("source").alias("subset"))
    canary = pack.blocks(tokens.byte_ids(table(spark, d, "benchmark")), [], "item_id", 256, tail="pad").select(F.lit("canary").alias("subset"))
    every = by.unionByName(canary).unionByName(by.select(F.lit("all").alias("subset")))
    return every.groupBy("subset").agg(F.count("*").alias("blocks")).withColumn("last", (F.col("subset") == "all").cast("int"))


@query(f"""WITH l AS (SELECT doc_id, length(h) // 2 AS a, length(t) AS b FROM {TOKENS})
SELECT round(avg(a), 6) AS mean_bytes, round(avg(b), 6) AS mean_chars, median(a)::DOUBLE AS median_bytes, round(avg(a::DOUBLE / b) FILTER (b > 0), 9) AS ratio, (SELECT round((s[j] * (10 - ((n + 1) * 9 - j * 10)) + s[j + 1] * ((n + 1) * 9 - j * 10)) / 10.0::DOUBLE, 6) FROM (SELECT *, len(s) AS n, (len(s) + 1) * 9 // 10 AS j FROM (SELECT list_sort(list(a)) AS s FROM l))) AS p90 FROM l""")
def tokenizer_compare(spark, d):
    own = tokens.byte_ids(ready(spark, d).select("doc_id", F.col("t").alias("text"), F.length("t").alias("b"))).withColumn("a", F.size("ids"))
    mean = own.agg(F.round(F.avg("a"), 6).alias("mean_bytes"), F.round(F.avg("b"), 6).alias("mean_chars"), F.round(F.avg(F.when(F.col("b") > 0, F.col("a") / F.col("b"))), 9).alias("ratio"))
    ranks = quantiles(own.select("a"), [], "a", {"median_bytes": linear(0.5), "p90": exclusive(10, 9)}).withColumn("p90", F.round("p90", 6))
    return mean.crossJoin(ranks)  # one row each


@query()
def bpe_token_counts(spark, d):
    """Tokens of each document by a public vocabulary, with BOS and EOS: no SQL can express it."""
    import public_tokenizers

    own = tokens.file_ids(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), bos=50256, eos=50256)
    return own.select("doc_id", F.size("ids").alias("n_tokens"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))
