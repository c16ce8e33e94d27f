import hashlib
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import token_counts as tc
from strandline.llm.bpe import WordBpe, encode_decode


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(tokenizer_path, odd_texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), WordBpe(path)
    for text, (n, ids, decoded) in zip(odd_texts, ours.encode_batch(odd_texts), strict=True):
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want and n == len(want), repr(text)[:80]
        assert decoded == theirs.decode(want, skip_special_tokens=False)
        assert ours.decode(want) == decoded


def test_long_words(tokenizer_path):
    import random

    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    theirs, ours, rng = Tokenizer.from_file(path), WordBpe(path), random.Random(3)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "aé中b", "a"):
        for size in (257, 258, 300, 1000, 30_000):
            word = "".join(rng.choices(alphabet, k=size))
            assert ours.encode(word) == theirs.encode(word, add_special_tokens=False).ids, (alphabet, size)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begin = time.time()
    ids = ours.encode(word)
    assert time.time() - begin < 20 and ids == theirs.encode(word, add_special_tokens=False).ids


def test_bpe_operator(spark, tokenizer_path):
    rows = [(1, "Hello, world"), (2, None), (2, None), (None, "a" * 400_000 + " b"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    out = encode_decode(df, tokenizer_path("word_bpe_49k.json"), outputs=True).collect()
    assert len(out) == 5
    for r in out:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == sha(" ".join(map(str, r.ids))) and r.decoded_sha256 == sha(r.decoded)
    assert [(r.n_tokens, r.decoded) for r in out if r.doc_id == 2] == [(0, "")] * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, tokenizer_path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("frequent", [1, 50, 400_000])
def test_token_counts_equal_the_library(spark, tokenizer_path, odd_texts, monkeypatch, frequent):
    import sentencepiece

    monkeypatch.setattr(tc, "FREQUENT", frequent)
    monkeypatch.setattr(tc, "MEMORY", 1000)
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tc.PieceCounter(path).cuts
    want = [len(model.encode(t)) if t else 0 for t in odd_texts]
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string").withColumn("n_bytes", F.lit("x")).withColumn("part", F.lit(1))
    out = {r.doc_id: r for r in tc.token_counts(df, path, limit=600).collect()}
    assert len(out) == len(odd_texts)
    for i, (text, n) in enumerate(zip(odd_texts, want, strict=True)):
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((text or "").encode()), n, n > 600)
    assert tc.token_counts(df.limit(0), path).collect() == []


def test_token_counts_of_texts_that_cannot_be_cut(spark, tokenizer_path, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    whole = {r.doc_id: r.n_tokens for r in tc.token_counts(spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string"), path).collect()}
    rows = [(1, "some words here"), (1, "some words here"), (None, "x"), (2, None)]
    monkeypatch.setattr(tc, "PieceCounter", type("Uncut", (tc.PieceCounter,), {"__init__": lambda self, p: (tc_init(self, p), setattr(self, "cuts", False))[0]}))
    out = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out)[1:] == [(1, whole[1]), (1, whole[1]), (2, 0)]


tc_init = tc.PieceCounter.__init__
