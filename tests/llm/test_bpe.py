import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import tokens
from spindrift.llm.bpe import BacktrackBPE, default_path, read_ranks

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    with open(default_path(), "rb") as f:
        return BacktrackBPE(read_ranks(f.read()))


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_hard_texts(bpe, public):
    rng = random.Random(3)
    texts = ["a" * n for n in (1, 7, 100, 5001)] + ["ab" * 500, " " * 777, "\n" * 300, "-" * 999, "<|endoftext|>x", "日本語 🙂 é́", "  x"]
    texts += ["".join(rng.choice("abcdeinrst'  \n09é🙂") for _ in range(rng.randint(1, 300))) for _ in range(500)]
    for s in texts:
        assert bpe.encode(s) == public(s)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(bpe, public, s):
    assert bpe.encode(s) == public(s)


def test_round_trip_and_second_vocabulary(bpe):
    s = "Straße, naïve — 1,234 “quoted”\r\n\t日本"
    assert b"".join(bpe.text[i].encode("latin-1") for i in bpe.encode(s)).decode() == s
    import tiktoken

    with open(default_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    from spindrift.llm.bpe import SPLIT_PATTERN

    other = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert BacktrackBPE(ranks).encode(s) == other.encode_ordinary(s)


def test_long_text_is_linear(bpe):
    import time

    t = time.time()
    n = len(bpe.encode("xqzj" * 250_000))
    assert n > 0 and time.time() - t < 20


def test_operator(spark, public):
    df = spark.createDataFrame([(1, "Hello there", 5), (2, None, 5), (3, "", 5), (4, "  ", 5), (1, "Hello there", 6)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_ids(df, "doc_id", "text").collect())
    assert got == sorted([(1, public("Hello there")), (1, public("Hello there")), (2, []), (3, []), (4, public("  "))])
    assert tokens.encode_ids(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in tokens.count_tokens(df, "text", ["doc_id"]).orderBy("doc_id").collect()] == [2, 2, 0, 0, len(public("  "))]
