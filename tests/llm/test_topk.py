import math

import numpy as np
import pytest
from matchloom.llm import topk
from pyspark.sql import functions as F


def brute(data, k, every):
    rows = []
    for i, v in data:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for n, (q, a) in enumerate(rows):
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def data(n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    vs = (centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, 8))).astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vs)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(60)]  # ties
    rows += [rows[3], rows[20], rows[20], (30, rows[31][1]), (None, same), (2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2010, [0.5, -0.5]), (2020, [0.1, 0.1])]
    return rows


def run(spark, rows, k=5, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = topk.top_inner_products(df, F.col("id") % every == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def test_matches_brute_force(spark):
    rows = data()
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(as_float, 5, 10)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 50)
    rows = data(seed=4)
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, k=3) == brute(as_float, 3, 10)


def test_elimination_is_exact_and_saves_work():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 400
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 10)
    v *= (400 / np.sqrt((v**2).sum(1)))[:, None]
    v = np.floor(v)
    pivots = topk.choose_pivots(v[:500], 32)
    dist = np.sqrt(((v[:, None, :] - pivots[None]) ** 2).sum(2))
    ids = np.arange(4000)
    q, i, s, n_scores = topk.best_of_block(v[:40], ids[:40], dist[:40], np.full(40, -np.inf), v, ids, ids, dist, 5)
    assert sum(n_scores) < 40 * 4000 / 4
    full = v[:40] @ v.T
    best = [sorted((-full[n, j], j) for j in range(4000) if j != n)[:5] for n in range(40)]
    for n in range(40):
        assert [(-a, b) for a, b in best[n]] == [(s[m], i[m]) for m in range(len(q)) if q[m] == n and i[m] is not None]
    # A threshold that holds spares more and loses nothing, ties at it included.
    least = np.array([-x[-1][0] for x in best])
    again = topk.best_of_block(v[:40], ids[:40], dist[:40], least, v, ids, ids, dist, 5)
    assert again[:3] == (q, i, s) and sum(again[3]) <= sum(n_scores)


def test_evaluated_is_counted_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    rows = [(i, v) for i, v in data() if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_inner_products(df, F.col("id") % 10 == 0).collect()
    assert all(5 <= r.evaluated < len(rows) for r in got)
    extra = df.selectExpr("*", "1 AS row", "2 AS least", "3 AS v")
    assert topk.top_inner_products(extra, F.col("id") % 10 == 0).count() == len(got)


def test_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_large_components(spark):
    """Scores are exact as far as a long goes, and beyond it raise."""
    big = [(i, [float((7 * i) % 23 - 11) * 2.0**18 + i, float(i % 5) * 2.0**19 - 1 / 256, 0.5]) for i in range(60)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    out = topk.top_inner_products(df, F.col("id") % 10 == 0, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == brute(big, 5, 10)
    for x in (2.0**40, 1e20):
        with pytest.raises(Exception, match="beyond a long|a component is"):
            topk.top_inner_products(spark.createDataFrame([(10, [x]), (20, [x])], "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).collect()
