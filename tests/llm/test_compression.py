import os
import random
import re
from collections import Counter

from tessera.llm import compression


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def prose(r, n):
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(n))


def cases():
    r = random.Random(4)
    out = [" ".join(r.choices(["a", "b", "c", "d", "é", "x#", "\n", "\n"], k=r.randint(0, 90))) for _ in range(80)]
    return out + [None, "", " \n", "a", "a\na\na", "a\r\na\n\x0b\n\x0b\n", "a b c " * 60] + out[:2]


def test_counts_match_brute_force(spark):
    rows = list(enumerate(cases()))
    got = {r.doc_id: tuple(r)[1:7] for r in compression.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t


def test_bands(spark):
    r = random.Random(6)
    clean = [prose(r, n) for n in (60, 300, 2000, 20000)]
    half = prose(r, 2000)
    noise = [os.urandom(3000).hex()[i : i + 60] for i in range(0, 6000, 60)]
    bad = [(half[:200] + " ") * 60, "\n".join(f"row {i % 7} of the same table again and again" for i in range(400))]
    rows = list(enumerate(clean + bad))
    got = [x.kept for x in sorted(compression.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect())]
    assert got == [True] * 4 + [False] * 2
    import base64

    packed = " ".join(base64.b85encode(os.urandom(40)).decode() for _ in range(200))
    assert not compression.quality(spark.createDataFrame([(1, packed)], "doc_id long, text string")).first().kept
    assert len(noise) == 100
    assert compression.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ratios_against_plain_chunks_and_the_tail_counts():
    import zstandard

    r = random.Random(9)
    bands, packer = compression.Bands(), zstandard.ZstdCompressor(level=3)
    for n in (100, 4096, 4097, 5000, 8192, 12_000, 30_000):
        text = prose(r, n)[:n].encode()
        if n % 2:
            text = text[: n // 2] + os.urandom(n - n // 2)
        bad = 0
        for i in range(0, n if n > 4096 else 0, 4096):
            part = text[max(0, min(i, n - 4096)) :][:4096]
            bad += min(4096, n - i) * (not 1.35 <= len(part) / len(zstandard.ZstdCompressor(level=3).compress(part)) <= 3.0)
        assert compression.ratios(text, bands, packer) == (n / len(packer.compress(text)), bad / n)
    junk = prose(r, 3000)[:8192].encode() + os.urandom(2000)
    assert compression.ratios(junk, bands, packer)[1] > 0
