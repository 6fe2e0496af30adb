import hashlib
import math

import numpy as np
import pytest
from matchloom.llm import balls
from pyspark.sql import functions as F


def brute(data, k, rounds, dims, scale=64):
    rows = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in data if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in rows:
            own[nearest(v)[1]].append(v)
        c = [tuple(sum(x) // len(vs) for x in zip(*vs)) if vs else w for vs, w in zip(own, c)]
    out = [(i, *reversed(nearest(v))) for i, v in rows]
    each = {n: sum(d for _, m, d in out if m == n) for _, n, _ in out}
    return sorted(((i, n, d, each[n], sum(each.values()), c[n]) for i, n, d in out), key=repr)


def data(n=400, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    vs = centres[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, dims))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vs)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # more equal ones than a leaf holds
    # Between others, for ties; repeated rows and ids, none, and those that take no part.
    rows += [(2000 + i, [float(i % 3 - 1) / 64] * dims) for i in range(60)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[9][1]), (None, None), (5000, None), (5001, []), (5002, [1.0] * (dims - 1)), (5003, [float("nan")] * dims), (5004, [float("inf")] * dims), (5005, [None] * dims)]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = balls.clustered(df, **how).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr)


@pytest.mark.parametrize("k, rounds", [(16, 3), (1, 2), (5, 0)])
def test_matches_brute_force(spark, k, rounds):
    rows = data()
    assert run(spark, rows, k=k, rounds=rounds, dims=8) == brute(rows, k, rounds, 8)


def test_small_trees(spark, monkeypatch):
    monkeypatch.setattr(balls, "TREE", 37)
    monkeypatch.setattr(balls, "LEAF", 3)
    rows = data(seed=5)
    assert run(spark, rows, dims=8) == brute(rows, 16, 3, 8)


def test_ties_go_to_the_smaller_number():
    c = np.array([[4, 0], [-4, 0], [0, 4], [4, 0]], np.int64)
    v = np.array([[0, 0]] * 50 + [[3, 0], [0, -9], [0, 5], [-1, 1]], np.int64)
    order, nodes = balls.ball_tree(v)
    cluster, counts, sums, _ = balls.assigned(v[order], nodes, c)
    want = balls.squared(v[order], c).argmin(1)
    assert (cluster == want).all() and (counts == np.bincount(want, minlength=4)).all()
    assert all((sums[i] == v[order][want == i].sum(0)).all() for i in range(4))


def test_whole_balls_are_assigned_without_looking_at_vectors():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (16, 64))
    v = centres[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 64))
    order, nodes = balls.ball_tree(v)
    cluster, counts, _, compared = balls.assigned(v[order], nodes, centres)
    assert compared < 400 and (cluster == balls.squared(v[order], centres).argmin(1)).all() and counts.sum() == 4000
    # Every ball holds its vectors, and a node's children share them out.
    for i, (a, b) in enumerate(zip(nodes["start"], nodes["stop"])):
        assert (np.sqrt(((v[order[a:b]] - nodes["centre"][i]) ** 2).sum(1)) <= nodes["radius"][i] + 1e-9).all()
        if (n := nodes["first"][i]) >= 0:
            assert (nodes["start"][n], nodes["stop"][n], nodes["stop"][n + 1]) == (a, nodes["start"][n + 1], b)


def test_few_none_and_clashing_names(spark):
    assert run(spark, [], dims=8) == []
    few = data()[:3]
    assert run(spark, few, dims=8) == brute(few, 16, 3, 8)
    df = spark.createDataFrame(data(), "vec_id long, embedding array<double>")
    odd = df.select("*", F.lit(1).alias("id"), F.lit("x").alias("v"), F.lit(2).alias("cluster"), F.lit(0).alias("of"))
    assert balls.clustered(odd, dims=8).count() == len(brute(data(), 16, 0, 8))


def test_large_components(spark):
    rows = [(i, [float((i * 7919) % 1000) * 2000, -float(i) * 20000]) for i in range(80)]
    assert run(spark, rows, dims=2, k=4) == brute(rows, 4, 3, 2)
    with pytest.raises(Exception, match="a component is"):
        run(spark, [(1, [1e20, 0.0])], dims=2)
