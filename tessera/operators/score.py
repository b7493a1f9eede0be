"""Rule-based scores of responses. Every check is a Column; a prompt's checks are an array of (name, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T


def contains_any(low: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda n: low.contains(n))


def special_checks(response: Column, version: str = "v7") -> dict[str, Column]:
    """Named checks; those of prompts that name others pass."""
    low, words = F.lower(response), T.word_count(response)
    hits = sum((low.contains(t).cast("int") for t in fixed.DEBUG_TERMS), F.lit(0))
    seattle = (F.length(low) - F.length(F.replace(low, F.lit("seattle"), F.lit("")))) / len("seattle")
    checks = {
        "vegetarian": ~contains_any(low, fixed.MEAT),
        "ada_lovelace_basic": low.contains("ada lovelace") & contains_any(low, fixed.ADA_SIGNALS) & ~contains_any(low, fixed.ADA_WRONG.get(version, fixed.ADA_WRONG["v7"])),
        "uncertainty_behavior": contains_any(low, fixed.CAUTION) & ~contains_any(low, fixed.OVERCONFIDENT),
        "simple_itinerary": low.contains("coffee") & contains_any(low, fixed.BOOKSHOPS) & contains_any(low, fixed.WALKS) & (seattle < 6),
        "short_rewrite": ~contains_any(low, fixed.LETTERS) & (words <= 45),
        "brief_debug_plan": (T.list_items(response) >= 3) & (hits >= 2),
        "asks_for_clarification": response.contains("?") & contains_any(low, fixed.CLARIFYING),
        "sky_blue_basic": low.contains("blue") & contains_any(low, fixed.SCATTERING),
    }
    if version != "v5":
        checks |= {
            "is_greeting": contains_any(low, fixed.GREETING) | response.contains("?"),
            "is_empathetic": contains_any(low, fixed.EMPATHY),
            "is_persona": contains_any(low, fixed.PERSONA),
            "expresses_uncertainty": contains_any(low, fixed.UNCERTAINTY),
        }
    return checks


def checks(df: DataFrame, version: str = "v7") -> Column:
    """array<struct<name, passed>> in fixed order, for columns response, bucket, messages and the optional rules of a prompt:

    min_words, max_words, expect_list_min_items, must_include_all, must_include_any, avoid_substrings, special_checks.
    """
    r = F.coalesce(F.col("response"), F.lit(""))
    low, words = F.lower(r), T.word_count(r)
    has = set(df.columns)
    one = lambda name, passed, when=None: F.array(F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))) if when is None else F.when(when, F.array(F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))))
    many = lambda col, f: F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), f)
    out = [one("non_empty", T.strip(r) != "")]
    if version == "v7":
        out.append(one("no_role_leak", ~(r.contains(fixed.IM_START) | r.contains(fixed.IM_END))))
    elif version == "v6":
        out.append(one("no_role_leak", ~r.startswith("###")))
    out += [one("no_code", ~T.matches(r, "(?:" + fixed.RESPONSE_CODE + ")")), one("no_url", ~T.has_url(r)), one("low_repetition", T.repetition_score(r) >= 0.45)]
    if version != "v5" and "messages" in has:
        asked = F.array_distinct(F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: T.topic_words(m["content"]))))
        bucket = F.coalesce(F.col("bucket"), F.lit("general")) if "bucket" in has else F.lit("general")
        out.append(one("topic_adjacent", F.exists(asked, lambda w: low.contains(w)), (bucket != "social") & (F.size(asked) > 0)))
    for name, col, rule in (("min_words", "min_words", lambda c: words >= c), ("max_words", "max_words", lambda c: words <= c), ("list_items", "expect_list_min_items", lambda c: T.list_items(r) >= c)):
        if col in has:
            out.append(one(name, rule(F.col(col)), F.col(col).isNotNull()))
    named = lambda prefix, n, passed: F.struct(F.concat(F.lit(prefix), n).alias("name"), passed.alias("passed"))
    if "must_include_all" in has:
        out.append(many("must_include_all", lambda n: named("has:", n, low.contains(F.lower(n)))))
    if "must_include_any" in has:
        any_ = F.coalesce(F.col("must_include_any"), F.array().cast("array<string>"))
        out.append(one("must_include_any", F.exists(any_, lambda n: low.contains(F.lower(n))), F.size(any_) > 0))
    if "avoid_substrings" in has:
        out.append(many("avoid_substrings", lambda n: named("avoid:", n, ~low.contains(F.lower(n)))))
    if "special_checks" in has:
        known = F.create_map(*(x for k, v in special_checks(r, version).items() for x in (F.lit(k), v)))
        out.append(many("special_checks", lambda n: named("", n, F.coalesce(F.try_element_at(known, n), F.lit(True)))))
    none = F.array().cast("array<struct<name:string,passed:boolean>>")
    return F.concat(*(F.coalesce(x, none) for x in out))


def scored(df: DataFrame, version: str = "v7") -> DataFrame:
    """df with checks, passed, total and score = passed / max(1, total)."""
    out = df.withColumn("checks", checks(df, version))
    out = out.withColumn("passed", F.size(F.filter("checks", lambda c: c["passed"]))).withColumn("total", F.size("checks"))
    return out.withColumn("score", F.col("passed") / F.greatest("total", F.lit(1)))


def bucket_report(df: DataFrame) -> DataFrame:
    """(bucket, mean_score, n, passed, total) by bucket, and over all in the row of a null bucket."""
    return df.rollup("bucket").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"), F.sum("passed").alias("passed"), F.sum("total").alias("total"))
