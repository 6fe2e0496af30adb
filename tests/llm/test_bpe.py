import hashlib
import random
import time

import public_tokenizers
import pytest
from matchloom.llm import bpe
from tests.llm import docs
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(open(FILE, encoding="utf-8").read())


def same(encoder, tokenizer, texts):
    for x, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(x) == want.ids, x[:200]
        (n, ids, text), = encoder.digests([x])
        assert n == len(want.ids) and ids == ",".join(map(str, want.ids))
        assert text == tokenizer.decode(want.ids, skip_special_tokens=False) == x


def test_odd_texts_equal_the_library(tokenizer, merges, monkeypatch):
    rng = random.Random(7)
    bits = ["a", "It", "'s", "'", "'ll", "é", "É", "é", " ", "  ", "\n", " \n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "　", "﻿"]
    bits += ["1", "23", "½", "٣", "日", "😀", "👩‍👩‍👧", "<|endoftext|>", "<|endof", "Σ", "İ", "ﬁ", "#$%", "...", "word", "Words", "\x00", "\x7f", "हिन्दी", "", "\U0010ffff"]
    monkeypatch.setattr(bpe, "KEPT_STRETCHES", 300)
    same(bpe.Encoder(merges), tokenizer, ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(6000)])


def test_every_character_is_of_the_librarys_kind(tokenizer, merges):
    e = bpe.Encoder(merges)
    same(e, tokenizer, [f"a{c}b {c}1 {c} {c}\n" for c in map(chr, [*range(0xD800), *range(0xE000, 0x3400), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)])])


def test_long_words(tokenizer, merges):
    rng = random.Random(1)
    long = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "x" * 65, "the" * 22, "é" * 700, " " * 900, "\n" * 300 + "x", "=-" * 4000]
    same(bpe.Encoder(merges), tokenizer, long)
    began = time.perf_counter()
    assert len(bpe.merge_one(b"abcdefghij" * 20_000, merges)) > 1000
    assert time.perf_counter() - began < 20


def test_forest_and_single_trees_agree(merges):
    rng = random.Random(2)
    words = list({bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(2000)})
    both = bpe.merge_words(words, merges)
    assert all(both[w] == bpe.merge_one(w, merges) for w in words)


def test_query_columns(spark, tokenizer):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digested(docs.frame(spark), FILE).collect())
    want = []
    for d, t, *_ in docs.rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t or ""))))
    assert got == sorted(want)
    assert bpe.digested(docs.empty(spark), FILE).count() == 0


def test_encoded_and_decoded_keep_columns(spark):
    df = docs.frame(spark).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "text_")
    out = bpe.decoded(bpe.encoded(df, FILE), FILE, "ids", "again")
    assert out.columns == [*df.columns, "ids", "again"]
    assert all(r.again == (r.text or "") for r in out.collect())
    nameless = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.digested(nameless, FILE).collect()) == [0, 2]
