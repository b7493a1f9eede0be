"""DuckDB spellings of the text functions, for the oracles."""

from __future__ import annotations

from tessera.functions import fixed

_CLASS = "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in fixed.WHITE) + "]"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_CLASS}+|{_CLASS}+$', '', 'g')"


def ratio(*parts: str) -> str:
    joined = " || ".join(f"{p} || chr(0)" for p in parts)
    return f"(('0x' || substr(sha256({joined}), 1, 16))::UBIGINT::DOUBLE / 1.8446744073709552e19)"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(fixed.WORD)})"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def found(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {quote(pattern.replace('.+', '[^' + chr(92) + 'n]+'))}, '{flags}')"


def code(x: str) -> str:
    symbols = f"length(regexp_replace({x}, {quote('[^{}' + chr(92) + '[' + chr(92) + ']();<>`' + chr(92) * 2 + ']')}, '', 'g'))"
    return f"({found(x, '(?:' + '|'.join(fixed.CODE_PATTERNS) + ')')} OR ({symbols} >= 10 AND {symbols} / greatest(length({x}), 1) > 0.06))"


def json(x: str) -> str:
    s = strip(x)
    return f"((starts_with({s}, '{{') AND ends_with({s}, '}}')) OR (starts_with({s}, '[') AND ends_with({s}, ']')) OR {found(s, fixed.JSON_KEY, 'c')})"


def grams(w: str) -> str:
    """Number of different trigrams / trigrams of a word list."""
    return f"(len(list_distinct(list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])))::DOUBLE / (len({w}) - 2))"


def lower_words(x: str) -> str:
    return f"list_transform({words(x)}, lambda q: lower(q))"


def split_lines(x: str) -> str:
    return f"regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x{{b}}\\f\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')"


def repetition(w: str, lines: str) -> str:
    """w: lower-cased word list column, lines: stripped, lower-cased, filled lines."""
    five = f"len(list_filter(range(1, len({w}) - 3), lambda i: {w}[i] = {w}[i + 1] AND {w}[i] = {w}[i + 2] AND {w}[i] = {w}[i + 3] AND {w}[i] = {w}[i + 4])) > 0"
    return f"(len({w}) >= 24 AND ({grams(w)} < 0.55 OR {five} OR (len({lines}) >= 4 AND len(list_distinct({lines})) <= len({lines}) * 0.6)))"


def filled_lines(x: str) -> str:
    return f"list_filter(list_transform({split_lines(x)}, lambda q: lower({strip('q')})), lambda q: q <> '')"


def spam(x: str) -> str:
    return f"(len(regexp_extract_all({x}, {quote(fixed.PLACEHOLDER)})) >= 2)"


def letter(x: str) -> str:
    return f"(starts_with(lower({x}), 'dear ') OR contains(lower({x}), {quote(fixed.LETTER_SENTENCE)}))"


def url(x: str) -> str:
    return found(x, "(?:" + fixed.URL + ")")


def request(x: str) -> str:
    return found(x, "(?:" + "|".join(fixed.PROGRAMMING_REQUESTS) + ")")


def flags(relation: str, keep: str, x: str) -> str:
    """A query of `keep` and all filter flags of text x."""
    return f"""SELECT {keep}, len(w) AS n_words, {code(x)} AS is_code, {json(x)} AS is_json, {repetition('w', 'l')} AS is_repetitive, {spam(x)} AS is_spam,
      {letter(x)} AS is_letter, {url(x)} AS has_url, {request(x)} AS is_request
    FROM (SELECT *, {lower_words(x)} AS w, {filled_lines(x)} AS l FROM {relation})"""


def usable(most: int) -> str:
    """Of the columns that flags() gives."""
    return f"(n_words BETWEEN 4 AND {most} AND NOT has_url AND NOT is_code AND NOT is_json AND NOT is_repetitive AND NOT (is_spam AND n_words > 40) AND NOT (is_letter AND n_words > 90))"


def chunks(x: str, size: int) -> str:
    return f"(CASE WHEN length({x}) <= {size} THEN [{x}] ELSE list_filter(list_transform(range(0, length({x}), {size}), lambda i: {strip(f'substr({x}, i + 1, {size})')}), lambda q: q <> '') END)"
