import re

from tessera.functions import fixed
from tessera.functions import text as T


def test_a_word_border_is_tested_once_for_all_patterns():
    for patterns in (fixed.CODE_PATTERNS, fixed.PROGRAMMING_REQUESTS):
        one = T.any_of(patterns)
        assert one.count(r"|\b(?:") == 1 and not re.search(r"\\b(?:import|debug)", one)
        assert all("|" not in re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", p) for p in patterns)
    assert T.any_of(["a"]) == "(?:a)" and T.any_of([r"\bx", r"\by\b"]) == r"(?:\b(?:x|y\b))"


def test_joined_patterns_find_what_each_finds(spark):
    texts = ["ımport ſys", "ximport os", "a\nfrom x\nimport y", "classe X", "class é", "class a", "SELECT a\nFROM b", "select a from b", "deſ f (", "def f (", "{}[]();<>`" * 2, "{}" * 5 + "x" * 200, "```", "éimport x", "Traceback", "untraceback", "api x endpoint", "rapi x endpoint", "stacK trace", "regexes", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)

    def plain(patterns):
        return T.matches("t", "(?:" + "|".join(patterns) + ")")

    for r in df.select("t", T.matches("t", T.any_of(fixed.CODE_PATTERNS)).alias("a"), plain(fixed.CODE_PATTERNS).alias("b"), T.programming_request("t").alias("c"), plain(fixed.PROGRAMMING_REQUESTS).alias("d"), T.looks_like_code("t").alias("e")).collect():
        assert r.a == r.b and r.c == r.d, r.t
        symbols = len(re.findall(r"[{}\[\]();<>`\\]", r.t or ""))
        assert r.t is None or r.e == (r.b or (symbols >= 10 and symbols / max(len(r.t), 1) > 0.06)), r.t
