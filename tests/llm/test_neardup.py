import random
from collections import defaultdict

import numpy as np
import pytest
from matchloom.llm import graph, neardup
from tests.llm import docs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(data, k, percent=80):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingle_set(t, k)) for d, t in data if d is not None]
    for i, (a, s) in enumerate(sets):
        find(a)
        for b, t in sets[:i]:
            c = len(s & t)
            if s and t and 100 * c >= percent * (len(s) + len(t) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in sets}


def check(df, data, k):
    want = brute(data, k)
    got = neardup.near_components(df, k=k).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    sizes = defaultdict(set)
    for d, t in data:
        sizes[d].add(len(shingle_set(t, k)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, k):
    check(docs.frame(spark), [(d, t) for d, t, *_ in docs.rows()], k)


@pytest.mark.parametrize("name, most", [("BLOCK", 8), ("BLOCK_SHINGLES", 1000)])
def test_large_family_over_several_blocks(spark, monkeypatch, name, most):
    monkeypatch.setattr(neardup, name, most)
    rng = random.Random(5)
    base = [docs.sentence(rng, 1) for _ in range(150)]
    data = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"odd{rng.randrange(10**6)}"
        data.append((200 - i, " ".join(w)))
    data += [(500, data[0][1]), (None, data[0][1]), (500, "another text under the same id"), (3, None)]
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(4), data, 4)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 700):
        s = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        sk = neardup.sketch(s)
        assert (sk > 0).all() and len(sk) == neardup.T and (neardup.sketch(s) == sk).all()
    got = []
    for _ in range(60):
        x = rng.integers(1, 2**63, 500, dtype=np.uint64)
        got.append((neardup.sketch(np.unique(x[:450])) == neardup.sketch(np.unique(x[50:]))).mean())
    assert abs(np.mean(got) - 0.8) < 0.02


def test_stage_and_empty(spark):
    df = docs.frame(spark)
    out = neardup.stage(spark, df, "")
    want = brute([(d, t) for d, t, *_ in docs.rows()], 5)
    assert out.schema == df.schema
    assert {r.doc_id for r in out.collect()} == {d for d, c in want.items() if d == c}
    assert neardup.near_components(docs.empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_of_one_doc_id_of_equal_size(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    data = [(1, t) for t in texts] + [(n + 2, t + "x") for n, t in enumerate(texts)]
    out = neardup.near_components(spark.createDataFrame(data, "doc_id long, text string"), 5).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 1)}
