"""Scans of source tables, shards, prompts, checkpoints and logs, and their validation."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


@dataclass
class Source:
    """One source of a mix. path: a table, or a folder of JSON lines, or {split: path}."""

    name: str
    path: str | dict[str, str] = ""
    weight: float = 1.0
    config: str = ""
    split: str = "train"
    kind: str = "parquet"
    text_fields: list[str] = field(default_factory=list)
    partition: str = "train"
    holdout_rate: float = 0.0
    holdout_salt: str = ""
    chatml_wrap_rate: float = 0.0
    long_text_chunk_chars: int = 200_000
    timeout_seconds: int = 180

    def __post_init__(self):
        if not self.name and not self.path:
            raise ValueError("a source needs a name or a path")
        if not self.weight > 0:
            raise ValueError(f"source {self.name}: the weight must be positive")
        if self.partition not in ("train", "eval"):
            raise ValueError(f"source {self.name}: partition must be train or eval")
        if not 0 <= self.holdout_rate < 1 or not 0 <= self.chatml_wrap_rate <= 1:
            raise ValueError(f"source {self.name}: rates must be shares")

    @property
    def label(self) -> str:
        return f"{self.name}[{self.config}]" if self.config else self.name


@dataclass
class BuildConfig:
    """A build of token shards."""

    sources: list[Source]
    seed: int = 0
    partition: str = "train"
    num_shards: int = 1
    block_size: int = 1024
    shard_tokens: int = 1_000_000

    def __post_init__(self):
        if not self.sources:
            raise ValueError("no sources")
        if self.num_shards < 1 or self.block_size < 1 or self.shard_tokens < 1:
            raise ValueError("sizes must be positive")
        if self.partition == "eval":
            self.num_shards = 1  # held-out rows are not dealt to shards

    @classmethod
    def load(cls, path: str) -> BuildConfig:
        """From a JSON file; a source's prob or weight is needed, other settings fall back to the build's."""
        with open(path, encoding="utf-8") as f:
            cfg = json.load(f)
        common = {k: cfg[k] for k in ("partition", "holdout_rate", "holdout_salt", "chatml_wrap_rate", "long_text_chunk_chars") if k in cfg}
        common |= {"timeout_seconds": int(cfg["source_timeout_seconds"])} if "source_timeout_seconds" in cfg else {}
        sources = []
        for i, s in enumerate(cfg.get("sources") or cfg.get("mix") or []):
            if not isinstance(s, dict):
                raise ValueError(f"source {i} is no object")
            weight = s.get("prob", s.get("weight"))
            if weight is None:
                raise ValueError(f"source {i} has no prob or weight")
            own = {k: s[k] for k in common if k in s}
            sources.append(Source(s.get("name", ""), s.get("data_files", s.get("path", "")), float(weight), s.get("config_name") or "", s.get("split", "train"), "json" if "data_files" in s else "parquet", list(s.get("text_fields", [])), **(common | own)))
        keep = {k: cfg[k] for k in ("seed", "partition", "num_shards", "block_size", "shard_tokens") if k in cfg}
        return cls(sources, **keep)


def transient(error: BaseException) -> bool:
    """Errors that may pass: by type or by what they say."""
    said = str(error).lower()
    return isinstance(error, (ConnectionError, TimeoutError)) or any(x in said for x in ("timed out", "timeout", "connection", "temporarily", "503", "502", "429", "reset by peer"))


def with_retries(f, tries: int = 8, first_wait: float = 2.0, sleep=time.sleep):
    """f(), tried again after waits that double, while its errors are transient. (Tasks that read data are retried by Spark.)"""
    for n in range(tries):
        try:
            return f()
        except Exception as e:
            if n == tries - 1 or not transient(e):
                raise
            sleep(first_wait * 2**n)


def timed(f, seconds: float, label: str):
    """f(), or a TimeoutError after so many seconds (its thread ends by itself)."""
    from concurrent.futures import ThreadPoolExecutor

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(f).result(seconds)
    except TimeoutError as e:
        raise TimeoutError(f"{label} timed out after {seconds} s") from e
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def opened(spark: SparkSession, source: Source, tries: int = 8, first_wait: float = 2.0, sleep=time.sleep) -> DataFrame:
    """scan with the source's timeout, tried again after errors that may pass."""
    return with_retries(lambda: timed(lambda: scan(spark, source), source.timeout_seconds, f"Opening {source.label}"), tries, first_wait, sleep)


def mirrored(spark: SparkSession, root: str, name: str, config: str = "", split: str = "train") -> DataFrame:
    """A dataset by name, configuration and split from a mirror of folders root/name/config/split (or root/name/split): parquet, else JSON lines."""
    from tessera.sources.sinks import _exists

    for path in dict.fromkeys((f"{root}/{name}/{config or 'default'}/{split}", f"{root}/{name}/{split}") if config else (f"{root}/{name}/{split}", f"{root}/{name}/default/{split}")):
        for kind in ("parquet", "json"):
            if _exists(spark, path):
                try:
                    return spark.read.format(kind).load(path)
                except Exception:  # another format
                    if kind == "json":
                        raise
    raise ValueError(f"no {name}[{config}] {split} under {root}")


#: Names of text columns, in the order in which they are looked for.
TEXT_COLUMNS = ("text", "content", "paragraph", "data")


def text_column(df: DataFrame, order: str | None = None) -> str:
    """The column of a known name, else the first whose value in the first row (of the order) is a text that is not blank."""
    for c in TEXT_COLUMNS:
        if c in df.columns:
            return c
    strings = [c for c, t in df.dtypes if t == "string"]
    row = (df.orderBy(order) if order else df).select(*strings).first() if strings else None
    for c in strings if row else ():
        if (row[c] or "").strip():
            return c
    raise ValueError(f"no text column in {df.columns}")


def scan(spark: SparkSession, source: Source) -> DataFrame:
    path = source.path[source.split] if isinstance(source.path, dict) else source.path
    return spark.read.json(path) if source.kind == "json" else spark.read.parquet(path)


def lenient_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text): all string values of each well-formed line of JSON objects; other lines are passed over."""
    raw = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    texts = F.transform(F.map_values(raw), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return spark.read.text(path).select(F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("text"))


def first_split(load, candidates: list[str]):
    """load(split) of the first split that can be loaded; else the last error."""
    last: Exception = ValueError("no splits")
    for c in candidates:
        try:
            return load(c)
        except Exception as e:
            last = e
    raise last


def texts(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """df's columns with text: a row for each text that extract_texts finds; without any, an error that names the columns."""
    found = T.extract_texts(dict(df.dtypes), fields)
    if not any(t in ("string", "array<string>") for _, t in df.dtypes):
        raise ValueError(f"no text column in {df.columns}")
    return df.withColumn("__texts", found).select(*[c for c in df.columns if c != "text"], F.posexplode("__texts").alias("text_no", "text"))


def shard_ids(spec: str, available: list[int]) -> list[int]:
    """Ids of a spec such as "0-19" or "0,3,7"; missing ones are an error."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        if m := re.fullmatch(r"(\d+)-(\d+)", part):
            out += range(int(m[1]), int(m[2]) + 1)
        else:
            out.append(int(part))
    if missing := sorted(set(out) - set(available)):
        raise ValueError(f"shards not found: {missing}")
    return sorted(set(out))


def shards(spark: SparkSession, root: str, limit: int | None = None, strict: bool = True, most_rows: int | None = None) -> DataFrame:
    """Blocks of a packed root, by the manifest beside it: only complete shards count.

    strict: an incomplete shard is an error; else it is passed over, and only a root without complete ones is.
    """
    manifest = spark.read.parquet(f"{root}/manifest").orderBy("shard_id").collect()  # a row for each shard
    bad = [r.shard_id for r in manifest if not r.complete]
    if strict and bad:
        raise ValueError(f"incomplete shards: {bad}")
    good = [r.shard_id for r in manifest if r.complete][:limit]
    if not good:
        raise ValueError(f"no complete shards in {root}")
    out = spark.read.parquet(f"{root}/blocks").where(F.col("shard_id").isin(good))
    return out.orderBy("shard_id", "block_id").limit(most_rows) if most_rows else out


def train_shards(spark: SparkSession, root: str) -> list[int]:
    """Ids of the complete shards of the train partition."""
    m = spark.read.parquet(f"{root}/manifest").where("complete and partition = 'train'")
    return [r.shard_id for r in m.select("shard_id").orderBy("shard_id").collect()]


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list of strings or objects, with their position pos."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "entry"))
    if raw.isEmpty():
        raise ValueError(f"not a list of prompts: {path}")
    schema = "user string, system string, id string, bucket string, messages array<struct<role:string,content:string>>, min_words int, max_words int, must_include_all array<string>, must_include_any array<string>, avoid_substrings array<string>, expect_list_min_items int, special_checks array<string>"
    object_ = F.col("entry").startswith("{")
    return raw.withColumn("o", F.when(object_, F.from_json("entry", schema))).select("pos", F.when(~object_, F.col("entry")).alias("text"), "o.*")


def checkpoints(names: DataFrame, eval_loss: DataFrame, state: DataFrame, contains: str | None = None, root: str = "final") -> DataFrame:
    """Checkpoints (name, path) with what is known of them, in the order of their keys: losses beside, then trainer state."""
    out = names.join(eval_loss, "name", "left").join(state.withColumnRenamed("eval_loss", "state_loss"), "name", "left")
    out = out.withColumn("eval_loss", F.coalesce("eval_loss", "state_loss")).drop("state_loss")
    if contains:
        out = out.where(F.col("name").contains(contains))
    return out.withColumn("key", T.checkpoint_key("name", root)).orderBy("key")


def merged_logs(logs: list[DataFrame]) -> DataFrame:
    """(tag, step, value) of several logs; of a step logged twice the last log's value stays."""
    every = None
    for i, df in enumerate(logs):
        own = df.withColumn("__log", F.lit(i))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("tag", "step").agg(F.max_by("value", "__log").alias("value"))
