import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from matchloom.llm import packing as P
from tests.llm import docs
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_tokens_equal_the_library(tokenizer, monkeypatch):
    import random

    rng = random.Random(3)
    bits = ["a", "It", "'s", "'", "é", "É", "é", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "1", "23", "日", "😀", "<|endoftext|>", "Σ", "İ", "ﬁ", "#$%", "\x0b", "word,", "word.", "İ.", "BİRİNCİ,", "ve İ", ",", ".", "क़"]
    monkeypatch.setattr(P, "KEPT_CHUNKS", 300)
    t = P.Tokens(open(FILE, encoding="utf-8").read())
    for _ in range(4000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(t.of([x])[0], "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, x


def test_points_after_any_letter(tokenizer):
    """A letter's normal form may end in a mark, which the tokenizer joins with a point."""
    t = P.Tokens(open(FILE, encoding="utf-8").read())
    texts = [x for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if c.isalpha() for x in (f"{c}.", f"ab{c},")]
    for x, got, want in zip(texts, t.of(texts), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, x


def test_placing_keeps_all_limits():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 1000, 700)
    loss = (tokens * rng.random(700)).astype(np.int64)
    limits = P.Limits(tokens=1000, segments=4, loss=600)
    loss = np.minimum(loss, 600)
    bins = P.placed(tokens, loss, limits)
    assert np.bincount(bins, tokens).max() <= 1000
    assert np.bincount(bins, loss).max() <= 600
    assert np.bincount(bins).max() <= 4 and np.bincount(bins).min() >= 1
    wide = P.placed(tokens, loss * 0, P.Limits(tokens=1000, segments=700, loss=1000))
    assert tokens.sum() / ((wide.max() + 1) * 1000) > 0.98
    assert len(P.placed(tokens[:0], loss[:0], limits)) == 0
    with pytest.raises(ValueError):
        P.placed(np.array([2000]), np.array([0]), limits)


def expected(ids, learned, limits):
    """Pieces of an example, one id after the other."""
    out, at, n, loss = [], 0, 0, 0
    for g in learned:
        if n + 1 > limits.tokens or loss + g > limits.loss:
            out.append((at, n, loss))
            at, n, loss = at + n, 0, 0
        n, loss = n + 1, loss + g
    return [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids), loss) for s, n, loss in [*out, (at, n, loss)]]


def check(rows, data, tokenizer, limits, with_ids=False):
    """data: (id, text or parts)."""
    want = defaultdict(list)
    for d, t in data:
        parts = t if isinstance(t, list) else [(t, True)]
        each = [tokenizer.encode(x or "", add_special_tokens=False).ids for x, _ in parts]
        ids = [i for x in each for i in x] + [2]
        learned = [g for x, (_, g) in zip(each, parts) for _ in x] + [parts[-1][1]]
        want[d] += expected(ids, [0, *learned[1:]], limits)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    with_loss = "loss" in rows[0]
    for d, own in pieces.items():
        found = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, *([r.loss] if with_loss else [])) for r in own)
        assert found == sorted(x if with_loss else x[:4] for x in want[d])
        if with_ids:
            assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        assert not with_loss or sum(r.loss for r in own) <= limits.loss


def test_pieces_and_sequences(spark, tokenizer):
    data = [(d, t) for d, t, *_ in docs.rows()]
    check(P.pack_examples(docs.frame(spark), FILE).collect(), data, tokenizer, P.Limits())
    few = P.Limits(tokens=64, segments=3, loss=60)
    check(P.pack_examples(docs.frame(spark), FILE, limits=few, ids=True).collect(), data, tokenizer, few, True)


def test_many_groups_nulls_and_empty(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "GROUP_PIECES", 10)
    data = [(None, "no id"), (None, None), *((1, "the same text") for _ in range(40)), (2, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    rows = P.pack_examples(df, FILE).collect()
    check(rows, data, tokenizer, P.Limits())
    assert len({r.sequence_id for r in rows}) > 1
    assert P.pack_examples(docs.empty(spark), FILE).count() == 0
    clash = docs.frame(spark).withColumnRenamed("lang", "start").withColumnRenamed("source", "group")
    assert P.pack_examples(clash, FILE).count() >= len(docs.rows())


def test_conversations_under_a_loss_limit_that_binds(spark, tokenizer):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = spark.createDataFrame([(9001, 1, "assistant", None), (9001, 0, None, "who asks"), (9002, 0, "user", "only a prompt")], "conv_id long, turn long, role string, text string")
    turns = table.select("conv_id", "turn", "role", "text").unionByName(odd)
    want = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append((r.text, r.role == "assistant"))
    free, tight = P.Limits(tokens=1024), P.Limits(tokens=1024, loss=200, segments=40)
    sequences = []
    for limits in (free, tight):
        rows = P.pack_examples(P.of_conversations(turns), FILE, limits=limits, ids=True).collect()
        check(rows, list(want.items()), tokenizer, limits, True)
        sequences.append(len({r.sequence_id for r in rows}))
    assert sequences[1] > sequences[0]  # the loss limit decides


def test_padding_is_little(spark):
    rows = P.op7_packing(spark, "/root/testdata/sf0.01").collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert sum(used.values()) / (4096 * len(used)) > 0.97
