import base64
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from knowmill.llm.tokens import FOLDER, PATTERN, Encoder, encode_corpus


@pytest.fixture(scope="module")
def ours():
    return Encoder(f"{FOLDER}/byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80))
def test_any_text(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_mixed_tokens(ours, theirs):
    rng = random.Random(2)
    words = list(ours.ids)
    for _ in range(20_000):
        try:
            text = "".join(rng.choice(words) for _ in range(3)).encode("latin-1").decode("utf-8")
        except UnicodeError:
            continue
        assert ours.encode(text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 50_000, "=" * 99_999, "の" * 50_000, " " * 100_001, "aA1" * 30_000])
def test_long_splits_take_linear_time(ours, text):
    import time

    began = time.perf_counter()
    ids = ours.encode(text)
    assert time.perf_counter() - began < 10
    back = {i: s for s, i in ours.ids.items()}
    assert "".join(back[i] for i in ids).encode("latin-1").decode("utf-8") == text


def test_corpus(spark, theirs):
    texts = [None, "", "  \n", "<|endoftext|>", "hello world", "hello world", "naïve \U0001f680"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    assert {r["doc_id"]: r["ids"] for r in encode_corpus(docs).collect()} == {i: theirs.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_corpus(docs.where("false")).collect() == []
