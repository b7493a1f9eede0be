"""The operators of this package as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, collocations, compression, decontaminate, html_extract, line_dedup, pii, quantiles, simhash, substring_dedup, toxicity, weak_quality
from tessera.llm.shared import read


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.col("hit_words").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("hit_words") > 0).alias("contaminated"),
    )


def vocabulary() -> str:
    """Path of the public byte-level vocabulary: TESSERA_VOCABULARY, else that of the installed package."""
    if path := os.environ.get("TESSERA_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(read(spark, sf_dir, "documents"))

    def joined(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(number, ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents"), report=True, whole=True)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed_lines").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.scores(read(spark, sf_dir, "documents"))


def op11_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks without a client or value and lines without an item, brand or price are left out, as are values that are no numbers; a null id has the batch of an empty text. Lines are counted by item and batch before they are joined."""
    c = F.col

    def batch(id_col):
        return F.pmod(F.crc32(F.coalesce(c(id_col).cast("string"), F.lit(""))), F.lit(16)).cast("int").alias("batch")

    def x(money):
        return (F.floor(100 * c(money) + 0.5) + 1000 * c("batch")).alias("x")

    def sound(money):
        return c(money).isNotNull() & ~F.isnan(money) & (F.abs(money) < float("inf"))

    clicks = read(spark, sf_dir, "clicks").where(c("client_id").isNotNull() & sound("value"))
    one = clicks.groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("row")).select(c("row.client_id").cast("string").alias("grp"), batch("click_id"), c("row.value").alias("value"))
    clicks = one.select(F.lit("value").alias("stream"), "grp", "batch", x("value"), F.lit(1).cast("long").alias("c"))
    lines = read(spark, sf_dir, "sale_lines").where(c("item_id").isNotNull()).groupBy("item_id", batch("vendor_id")).agg(F.count("*").alias("c"))
    items = read(spark, sf_dir, "items").where(c("brand").isNotNull() & sound("price")).select("item_id", "brand", "price")
    priced = lines.join(items, "item_id").select(F.lit("price").alias("stream"), c("brand").alias("grp"), "batch", x("price"), "c")
    return quantiles.summarise(clicks.unionByName(priced), ["stream", "grp"])


#: A conversation whose texts look like the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_compression": op5_compression,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_weak_quality": op8_weak_quality,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_quantiles": op11_quantiles,
    "op12_chat_format": op12_chat_format,
    "op13_collocations": op13_collocations,
}
#: SQL can express none of the others on whole tables in reasonable time; tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\c') as text_out,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\c'), ':', '\;') as role_out
  from t
), g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, x nulls first) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, r nulls first, x nulls first) filter (where role = 'assistant'), '') as loss,
    sum(length(text_out) + length(role_out) + 14) as formatted_chars
  from e group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from g
""",
    "op13_collocations": r"""
with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from p),
g as (select lang, w, unnest([1, 2, 3, 4, 5]) as k from w where len(w) > 0),
h as (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from g where len(w) >= k),
c as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f from h group by all),
n as (select lang, sum(f)::hugeint as n from c where k = 1 group by lang),
q as (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from c where k >= 2 and f >= 100),
u as (select lang, k, phrase, w, a, unnest(range(1, k)) as cut from q),
s as (
  select u.lang, u.phrase, u.k, u.a, n.n, l.f as l, r.f as r, (1000::hugeint * u.a * n.n) // (l.f::hugeint * r.f) as score,
    row_number() over (partition by u.lang, u.phrase order by (1000::hugeint * u.a * n.n) // (l.f::hugeint * r.f), cut) as best
  from u join c l on l.lang = u.lang and l.phrase = array_to_string(u.w[1 : cut], ' ')
    join c r on r.lang = u.lang and r.phrase = array_to_string(u.w[cut + 1 : u.k], ' ') join n on n.lang = u.lang
),
x as (
  select distinct s.lang, s.phrase from s join q on q.lang = s.lang and q.k > s.k and 100 * q.a >= 100 * s.a and contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ') where best = 1
),
t as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank from s anti join x on x.lang = s.lang and x.phrase = s.phrase where best = 1
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from t where rank <= 2000
""",
}
