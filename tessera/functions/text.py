"""Text functions and filters as Column expressions (no Python runs per row, but for exp and log)."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed

_WHITE = "".join(chr(i) for a, b in fixed.WHITE for i in range(a, b + 1))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once: inside a lambda an outer expression would be evaluated anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c) -> Column:
    """Without Unicode white space at both ends (trim() knows only U+0020)."""
    return F.btrim(_col(c), F.lit(_WHITE))


def filled(c) -> Column:
    """The text unless it is empty; null lets coalesce go on."""
    return F.when(_col(c) != "", _col(c))


def first_filled(*cs) -> Column:
    return F.coalesce(*(filled(c) for c in cs))


def words(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(fixed.WORD), F.lit(0))


def word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(fixed.WORD))


def matches(c, pattern: str) -> Column:
    """A caseless search with Unicode classes and \\n as the only line end."""
    return _col(c).rlike("(?iUd)" + pattern)


def any_of(patterns: list[str]) -> str:
    """One pattern that is found where any of these is. Those that begin at a word's border share its test, which a search would else make for each of them at each place. No pattern has a bare |."""
    at_words = [p[2:] for p in patterns if p.startswith("\\b")]
    return "(?:" + "|".join([p for p in patterns if not p.startswith("\\b")] + ["\\b(?:" + "|".join(at_words) + ")"] * bool(at_words)) + ")"


def splitlines(c) -> Column:
    return F.split(_col(c), "\\r\\n|[\\n\\r\\u000b\\f\\u001c-\\u001e\\u0085\\u2028\\u2029]", -1)


def hash_ratio(*parts) -> Column:
    """First 64 bits of SHA-256 over the parts, each followed by a zero byte, as a fraction of 2**64."""
    joined = F.concat(*(x for p in parts for x in (_col(p) if isinstance(p, Column) else F.lit(p), F.lit("\0"))))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def in_holdout(name: Column, text: Column, salt: str, rate: float) -> Column:
    return hash_ratio(name, text, salt) < F.lit(rate)


def shard_bucket(name: Column, text: Column, salt: str, shards: int) -> Column:
    return F.least(F.floor(hash_ratio(name, text, salt, "shard") * shards).cast("int"), F.lit(shards - 1))


def chat_wrapped(name: Column, text: Column, salt: str, rate: float) -> Column:
    return hash_ratio(name, text, salt, "chatml") < F.lit(rate)


def chatml_wrap(c) -> Column:
    head = f"{fixed.IM_START}user\n{fixed.CHATML_USER_PROMPT}{fixed.IM_END}\n{fixed.IM_START}assistant\n"
    return F.concat(F.lit(head), _col(c), F.lit(fixed.IM_END))


def text_chunks(c, size: int) -> Column:
    """Fixed slices of code points, each stripped, empty ones dropped; a short text stays whole."""
    if size <= 0:
        return F.array(_col(c))

    def cut(c):
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size)), lambda i: strip(F.substring(c, i + 1, F.lit(size))))
        return F.when(F.length(c) <= size, F.array(c)).otherwise(F.filter(cuts, lambda x: x != ""))

    return let(_col(c), cut)


def normalise_light(c) -> Column:
    c = F.regexp_replace(_col(c), "\r\n", "\n")
    c = F.regexp_replace(c, "[ \t]{3,}", "  ")
    return strip(F.regexp_replace(c, "\n{4,}", "\n\n\n"))


def normalise_role(c) -> Column:
    r = F.lower(strip(c))
    return F.when(r == "system", "system").when(r.isin("user", "human", "prompter"), "user").when(r.isin("assistant", "bot", "gpt"), "assistant")


def extract_texts(columns: dict[str, str], fields: list[str] | None = None) -> Column:
    """Texts of a row: of the first field that is a non-blank string or a list with non-blank strings; "*": of all columns.

    columns: names and types of the table, as in df.dtypes.
    """
    def texts(name: str) -> Column | None:
        kind = columns.get(name)
        if kind == "string":
            return F.when(strip(name) != "", F.array(F.col(name)))
        if kind == "array<string>":
            kept = F.filter(F.col(name), lambda x: strip(x) != "")
            return F.when(F.size(kept) > 0, kept)
        return None

    none = F.array().cast("array<string>")
    fields = fields or fixed.TEXT_FIELDS
    for i, f in enumerate(fields):
        if f == "*":
            every = [F.coalesce(t, none) for t in map(texts, columns) if t is not None]
            earlier = [t for t in map(texts, fields[:i]) if t is not None]
            return F.coalesce(*earlier, F.flatten(F.array(*every)) if every else none)
    found = [t for t in map(texts, fields) if t is not None]
    return F.coalesce(*found, none) if found else none


def single_text(columns: dict[str, str]) -> Column:
    """Stripped text of the first usual field, else of the first other string column, that is not blank."""
    names = [f for f in fixed.FIRST_TEXT_FIELDS if columns.get(f) == "string"]
    names += [c for c, t in columns.items() if t == "string" and c not in names]
    return F.coalesce(*(filled(strip(c)) for c in names)) if names else F.lit(None).cast("string")


def first_text(columns: dict[str, str], fields: list[str]) -> Column:
    """Stripped text of the first of the given fields that is not blank, else empty."""
    return F.coalesce(*(filled(strip(f)) for f in fields if columns.get(f) == "string"), F.lit(""))


def source_name(name, config) -> Column:
    return F.when(F.coalesce(_col(config), F.lit("")) != "", F.concat(_col(name), F.lit("["), _col(config), F.lit("]"))).otherwise(_col(name))


def source_slug(c) -> Column:
    known = F.create_map(*(F.lit(x) for kv in fixed.SOURCE_SLUGS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, _col(c)), F.translate(F.element_at(F.split(_col(c), "/"), -1), "-.", "__"))


def fingerprint(c) -> Column:
    """First 16 bytes of SHA-256, as hex."""
    return F.substring(F.sha2(_col(c), 256), 1, 32)


def block_fingerprint(ids) -> Column:
    """fingerprint of ids as two little-endian bytes each; ids of 65536 or more are an error."""
    ids = _col(ids)
    cells = F.transform(ids, lambda t: F.concat(F.lpad(F.hex(t.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(t, 8)), 2, "0")))
    checked = F.when(F.exists(ids, lambda t: (t >= 65536) | (t < 0)), F.raise_error(F.lit("token id does not fit two bytes"))).otherwise(F.array_join(cells, ""))
    return F.substring(F.sha2(F.unhex(checked), 256), 1, 32)


# --- filters -------------------------------------------------------------------------------------------------------


def looks_like_code(c) -> Column:
    c = _col(c)
    symbols = F.length(F.regexp_replace(c, r"[^{}\[\]();<>`\\]+", ""))
    found = matches(c, any_of(fixed.CODE_PATTERNS))
    return found | ((symbols >= 10) & (symbols / F.greatest(F.length(c), F.lit(1)) > 0.06))


def looks_like_json(c) -> Column:
    s = strip(c)
    return (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]")) | s.rlike("(?Ud)" + fixed.JSON_KEY)


def distinct_share(ws: Column, n: int = 3) -> Column:
    """Different n-grams / n-grams; null under n words."""

    def share(ws):
        grams = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.concat_ws(" ", *(F.element_at(ws, (i + k).cast("int")) for k in range(n))))
        return F.when(F.size(ws) >= n, F.size(F.array_distinct(grams)) / (F.size(ws) - (n - 1)))

    return let(ws, share)


def bad_repetition(c) -> Column:
    c = _col(c)

    def same(ws, i):
        return reduce(lambda a, b: a & b, [F.try_element_at(ws, i + k) == F.try_element_at(ws, i) for k in range(1, 5)])

    def by_words(ws):
        five = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1))), lambda i: same(ws, i))
        return F.when(F.size(ws) < 24, F.lit(0)).when((distinct_share(ws) < 0.55) | F.coalesce(five, F.lit(False)), F.lit(2)).otherwise(F.lit(1))

    def by_lines(lines):
        return (F.size(lines) >= 4) & (F.size(F.array_distinct(lines)) <= F.size(lines) * F.lit(0.6))

    state = let(F.transform(words(c), F.lower), by_words)
    lines = F.filter(F.transform(splitlines(c), lambda x: F.lower(strip(x))), lambda x: x != "")
    return let(state, lambda s: F.when(s == 2, F.lit(True)).when(s == 1, let(lines, by_lines)).otherwise(F.lit(False)))


def placeholder_spam(c) -> Column:
    return F.regexp_count(_col(c), F.lit(fixed.PLACEHOLDER)) >= 2


def form_letter(c) -> Column:
    low = F.lower(_col(c))
    return low.startswith(fixed.LETTER_OPENING) | low.contains(fixed.LETTER_SENTENCE)


def has_url(c) -> Column:
    return matches(c, "(?:" + fixed.URL + ")")


FLAGS = ("n_words", "is_code", "is_json", "is_repetitive", "is_spam", "is_letter", "has_url")


def filter_flags(c) -> list[Column]:
    """FLAGS of a text, each taken once; usable_flags judges by them."""
    return [f(c).alias(n) for n, f in zip(FLAGS, (word_count, looks_like_code, looks_like_json, bad_repetition, placeholder_spam, form_letter, has_url), strict=True)]


def usable_flags(most_words: int = 200) -> Column:
    """Whether an assistant message with these FLAGS columns is usable."""
    return _usable(*(F.col(x) for x in FLAGS), most_words)


def _usable(n, code, json, repetitive, spam, letter, url, most_words: int) -> Column:
    return n.between(4, most_words) & ~(url | code | json | repetitive | (spam & (n > 40)) | (letter & (n > 90)))


def assistant_usable(c, most_words: int = 200) -> Column:
    return _usable(word_count(c), looks_like_code(c), looks_like_json(c), bad_repetition(c), placeholder_spam(c), form_letter(c), has_url(c), most_words)


def programming_request(c) -> Column:
    return matches(c, any_of(fixed.PROGRAMMING_REQUESTS))


def list_items(c) -> Column:
    return F.regexp_count(_col(c), F.lit("(?mUd)" + fixed.LIST_ITEM))


def repetition_score(c) -> Column:
    share = lambda ws: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distinct_share(ws) - 0.45) / 0.45))
    return let(F.transform(words(c), F.lower), lambda ws: F.when(F.size(ws) < 12, F.lit(1.0)).otherwise(share(ws)))


def topic_words(c) -> Column:
    stop = F.array(*map(F.lit, fixed.TOPIC_STOP_WORDS))
    long = F.filter(words(c), lambda w: (F.length(w) > 4) & ~F.array_contains(stop, F.lower(w)))
    return F.array_sort(F.array_distinct(F.transform(long, F.lower)))


# --- rendering -----------------------------------------------------------------------------------------------------


def render_chat(messages, style: str = "chatml") -> Column:
    """Prompt of array<struct<role, content>> with a trailing assistant header; an unknown role is an error."""
    messages = _col(messages)
    known = list(fixed.PREFIX_ROLES)

    def one(m):
        body = strip(m["content"])
        if style == "chatml":
            text = F.concat(F.lit(fixed.IM_START), m["role"], F.lit("\n"), body, F.lit(fixed.IM_END + "\n"))
        else:
            prefix = F.create_map(*(F.lit(x) for kv in fixed.PREFIX_ROLES.items() for x in kv))
            text = F.concat(F.element_at(prefix, m["role"]), body, F.lit("\n"))
        return F.when(m["role"].isin(known), text).otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), F.coalesce(m["role"], F.lit("null")))))

    tail = f"{fixed.IM_START}assistant\n" if style == "chatml" else fixed.PREFIX_ROLES["assistant"]
    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit(tail))


def cut_response(c, stops: list[str] | None = None) -> Column:
    """Up to the first stop marker, stripped."""
    c = _col(c)
    stops = stops or [fixed.IM_END, fixed.IM_START]
    at = F.least(*(F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops))
    return strip(F.when(at.isNull(), c).otherwise(F.substring(c, F.lit(1), at - 1)))


def instruction_prompt(instruction, given) -> Column:
    """The prompt part of an instruction example, with its input if there is one."""
    i, g = strip(F.coalesce(_col(instruction), F.lit(""))), strip(F.coalesce(_col(given), F.lit("")))
    middle = F.when(g != "", F.concat(F.lit("### Input:\n"), g, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), i, F.lit("\n\n"), middle, F.lit("### Response:\n"))


def flatten_content(parts) -> Column:
    """Joined text of the text parts of array<struct<type, text>>."""
    return F.array_join(F.transform(F.filter(_col(parts), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def completion(text, prompt) -> Column:
    """The text without the prompt that it starts with."""
    text, prompt = _col(text), _col(prompt)
    return F.when(text.startswith(prompt), F.substring(text, F.length(prompt) + 1, F.length(text))).otherwise(text)


def _of_libm(f):
    """A double column by a function of the C library, which SQL engines and Python share; Java's own differs in the last bit of some values."""

    def run(x):
        return pa.array(map(f, x.to_pylist()), pa.float64())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def exp(x) -> Column:
    def one(v):
        try:
            return None if v is None else math.exp(v)
        except OverflowError:
            return math.inf

    return _of_libm(one)(_col(x).cast("double"))


def log(x) -> Column:
    """Natural logarithm; null of what is not above zero."""
    return _of_libm(lambda v: None if v is None or v <= 0 else math.log(v))(_col(x).cast("double"))


def perplexity(loss) -> Column:
    return F.when(_col(loss) < 30, exp(loss)).otherwise(F.lit(float("inf")))


def checkpoint_key(name, root: str = "final") -> Column:
    """(class, tokens, name) to sort checkpoints by: milestones and steps by tokens, others after, the root last."""
    name = _col(name)
    tokens, step = F.regexp_extract(name, r"^checkpoint-(\d+(?:\.\d+)?)B-tokens$", 1), F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    number = (
        F.when(name == root, F.struct(F.lit(2).alias("class"), F.lit((1 << 63) - 1).alias("tokens"), name.alias("name")))
        .when(tokens != "", F.struct(F.lit(1).alias("class"), (F.when(tokens != "", tokens).cast("decimal(18,6)") * 1_000_000_000).cast("long").alias("tokens"), name.alias("name")))
        .when(step != "", F.struct(F.lit(1).alias("class"), (F.when(step != "", step).cast("long") * fixed.TOKENS_PER_STEP).alias("tokens"), name.alias("name")))
    )
    return F.coalesce(number, F.struct(F.lit(2).alias("class"), F.lit(0).cast("long").alias("tokens"), name.alias("name")))


def metric_value(metrics) -> Column:
    """The preferred metric of a map<string, double>, else its first."""
    m = _col(metrics)
    return F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in ("acc_norm,none", "acc,none", "exact_match,none")), F.try_element_at(F.map_values(m), F.lit(1)))


def half_away(x, digits: int) -> Column:
    """x rounded as SQL engines round doubles: scaled, halves away from zero, scaled back. round() goes by the decimal text instead, and differs where x ends in a 5 behind the last digit."""
    scaled = _col(x) * F.lit(10.0**digits)
    # from 2**52 on a double has no fraction; infinities and NaN stay as they are
    return F.when(F.abs(scaled) < 2.0**52, F.round(scaled, 0) / F.lit(10.0**digits)).otherwise(_col(x))


def four_digits(x) -> Column:
    return F.when(_col(x).isNull(), F.lit("")).otherwise(F.format_string("%.4f", _col(x)))


def narrow_doubles(columns: list[tuple[str, str]]) -> list[Column]:
    """All columns, doubles as floats, so that tables of both can be united."""
    return [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in columns]


def within_context(prompt_tokens, new_tokens, context: int) -> Column:
    return _col(prompt_tokens) + _col(new_tokens) <= context
