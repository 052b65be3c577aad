import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomry.llm import tokenize
from fathomry.llm.tokenize import TOKENIZERS, Encoder, Vocabulary, encode, encode_words

VOCABULARY = Vocabulary.load("byte_bpe_50k")


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


HARD = ["", "<|endoftext|> x", "a" * 4097, " " * 3000 + "x", "é" * 999, "\x00\x85 \r\n\r\n\t a", "I'LL it's 'S", "🙂👍🏽 ½ ｆｕｌｌ", "لا 你好，世界 ありがとう", "abababababab" * 50, "x y﻿"]


def test_hard_texts(other):
    flat, ends = Encoder(VOCABULARY).texts(HARD)
    for i, t in enumerate(HARD):
        assert flat[ends[i] : ends[i + 1]].tolist() == other(t), t[:40]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_text(other, texts):
    encoder = Encoder(VOCABULARY)
    for part in (texts[:2], texts[2:]):
        flat, ends = encoder.texts(part)
        for i, t in enumerate(part):
            assert flat[ends[i] : ends[i + 1]].tolist() == other(t)


def test_stretches_don_t_show(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeing "), 12)).encode() for _ in range(3000)]
    whole = encode_words(words, VOCABULARY)
    monkeypatch.setattr(tokenize, "STRETCH", 50)
    small = encode_words(words, VOCABULARY)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()


def test_rows(spark, other):
    rows = [(1, "Hello world", "k"), (1, "Hello world", "k"), (2, None, None), (None, "", "x"), (3, "naïve — text", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("__text", F.lit(1))
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encode(df, "text", ["doc_id"]).collect()), key=str)
    assert got == sorted(((i or 0, other(t or "")) for i, t, _ in rows), key=str)
    counts = encode(df, "text", ["doc_id"], counts_only=True)
    assert sorted(r.ids for r in counts.collect()) == sorted(len(other(t or "")) for _, t, _ in rows)
    assert encode(df.where("false"), "text", ["doc_id"]).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert encode(df.where("false"), "text", ["doc_id"]).count() == 0
