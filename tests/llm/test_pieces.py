import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from matchloom.llm import pieces
from tests.llm import docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.tables(MODEL)


def same(both, text, encoder=None):
    sp, t = both
    e = encoder or pieces.Encoder(t)
    want = sp.encode(text)
    assert e.encode(text) == want
    ids = [*want, sp.eos_id()]
    n, decimals, decoded = next(iter(e.digests([text])))
    assert (n, decimals) == (len(ids), " ".join(map(str, ids)))
    assert decoded == sp.decode(ids) == pieces.decode(ids, t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_mixtures_and_long_runs(both):
    rng = random.Random(2)
    bits = ["a", "b", "ab", "aaaa", "the", " ", "  ", "\n", "\t", "▁", "é", "日", "\U00020000", "<s>", "====", "\x00", "00000", "ing", "�"]
    e = pieces.Encoder(both[1])
    for _ in range(1500):
        same(both, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), e)
    for c in ("a", "ab", "= ", " ", "日", "aaab", "\n"):
        same(both, c * 3000, e)


def test_very_long_words(both):
    import time

    rng = random.Random(4)
    base64 = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58), 43, 47]))
    texts = ["".join(rng.choice(letters) for _ in range(200_000)) for letters in (base64, base64[26:52], ["ing", "tion", "an", "th", "ed"])]
    began = time.process_time()
    for text in [*texts, "x" * 200_000, "an" * 100_000]:
        assert pieces.Encoder(both[1]).encode(text) == both[0].encode(text)
    assert time.process_time() - began < 25


def test_vocabulary_table_overflow(both, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 20)
    e = pieces.Encoder(both[1])
    for t in docs.texts():
        same(both, t or "", e)
    assert len(list(e.digests([t or "" for t in docs.texts()]))) == len(docs.texts())


def test_query_rows(spark, both):
    sp = both[0]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digested(docs.frame(spark), MODEL).collect())
    want = []
    for d, t, *_ in docs.rows():
        ids = [*sp.encode(t or ""), 2]
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.digested(docs.empty(spark), MODEL).count() == 0
    ids = {r.doc_id: r.ids for r in pieces.encoded(docs.frame(spark), MODEL).collect()}
    assert all(ids[d] == [*sp.encode(t or ""), 2] for d, t, *_ in docs.rows())
