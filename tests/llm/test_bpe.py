import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(2)
    chars = "abcdefghij THE the'sll  \n\t\r0123456789.,!?-_<|>éñüß中文字😀  \u0085\x1c\x0b​́"
    out = ["".join(r.choices(chars, k=r.randint(1, 80))) for _ in range(400)]
    out += ["", None, " ", "a", "<|endoftext|>", "x <|endoftext|>y<|endoftext|><|endoftext|> z", "<|endoftext", "a" * 3000, "ab" * 700, "the thing " * 500]
    out += ["퟿\U0010ffff", "don't we'll I'VE", "\0special <|endoftext|>", "\0special x", "é �"]
    return out


def test_ids_and_round_trip_match_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (list(r["ids"]), r.decoded) for r in bpe.encode_decode(df, PATH).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False)), text
        assert got[i][1] == (text or "")


def test_small_memo_and_empty_table(spark):
    with open(PATH) as f:
        vocab = bpe.Vocabulary(f.read())
    small, large = bpe.Encoder(vocab, memo=20), bpe.Encoder(vocab)
    for t in texts():
        assert small.encode([t or ""])[0].tolist() == large.encode([t or ""])[0].tolist()
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_pre_tokens_match_the_library():
    import time

    t = Tokenizer.from_file(PATH)
    with open(PATH) as f:
        vocab = bpe.Vocabulary(f.read())
    r = random.Random(6)
    began = time.time()
    for text in ("a" * 100_000, "".join(r.choices("etaoinshr", k=60_000)), "".join(r.choices("中文字漢", k=5000)), "ab" * 300, "x" * 256, "xy" * 128 + "z"):
        ids, at = bpe.Encoder(vocab).encode([text, "short", text[:300]])
        for i, x in enumerate((text, "short", text[:300])):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids
    assert time.time() - began < 30
