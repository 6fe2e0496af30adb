"""The registered queries over the smallest driver tables, against twins or plain Python that uses none of the operators."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from matchloom.llm import packing, pii, registry
from tests.llm import test_packing, test_sharding, test_substring
from tokenizers import Tokenizer

D = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not D.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def data():
    return duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall()


def rows(spark, name):
    return registry.queries()[name](spark, str(D)).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twins_agree(spark, name):
    c = duckdb.connect()
    for f in D.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = c.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(D))
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted((tuple(r[rel.columns.index(k)] for k in cols) for r in rel.fetchall()), key=repr)


def test_op2(spark, data):
    def luhn(d):
        return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    got = {r.doc_id: r for r in rows(spark, "op2_pii")}
    assert len(got) == len(data)
    for d, t in data:
        base = [[m.span() for m in re.finditer(p, t or "") if ok(m)] for _, p, ok in checks]
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, base))
        names = [f"{k}:{a}:{b}" for (k, *_), spans in zip(checks, base) for a, b in spans]
        assert r.base_sha256 == sha(",".join(names)) and set(names) <= set(r.spans.split(",") if r.spans else [])
        assert len([x for x in r.spans.split(",") if x]) == len(names) + r.n_added
        for x in r.spans.split(","):
            if x and x not in names:
                kind, a, b = x.split(":")
                assert kind in pii.KINDS and 0 <= int(a) < int(b) <= len(t)


def test_op4(spark, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in data:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op4_sentencepiece")) == sorted(want)


def test_op6(spark, data):
    want = test_substring.united(test_substring.brute_units(data, "line"), test_substring.brute_windows(data, 51))
    assert want and sorted((r.doc_id, r.span_start, r.span_end) for r in rows(spark, "op6_substring_dedup")) == want


def test_op7(spark, data):
    test_packing.check(rows(spark, "op7_packing"), data, Tokenizer.from_file(test_packing.FILE), packing.Limits())


def test_op8(spark, data):
    got = rows(spark, "op8_sharding")
    test_sharding.check(got, data, 24)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    size = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(size) - min(size) <= 2 * max(r.size for r in got)
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in data}


def test_op1(spark, data):
    got = {r.doc_id: r for r in rows(spark, "op1_toxicity_chain")}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{D}/labels.parquet'").fetchall())
    assert set(got) == {d for d, _ in data}
    assert sum(got[d].toxic == bool(t) for d, t in labels.items() if d in got) / len(labels) > 0.9
