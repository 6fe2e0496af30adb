import random

import numpy as np
import pytest
from matchloom.operators import quantile
from pyspark.sql import functions as F

WANTED = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def test_equal_to_a_whole_sort(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([None, 1.0, 2.5, round(rng.gauss(0, 1), 3)])) for g in ("a", "b", None) for _ in range(200)] + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    got = {r.g: [r[n] for n in WANTED] for r in quantile.quantiles(df, "x", WANTED, "g").collect()}
    assert set(got) == {"a", "b", None, "c", "d"} and got["c"] == [None] * 5 and got["d"] == [7.0] * 5
    for g in ("a", "b", None):
        assert np.allclose(got[g], np.quantile([x for k, x in data if k == g and x is not None], list(WANTED.values())), atol=1e-12)
    one = quantile.quantiles(df, "x", WANTED).collect()
    assert len(one) == 1 and np.allclose(list(one[0]), np.quantile([x for _, x in data if x is not None], list(WANTED.values())), atol=1e-12)
    assert list(quantile.quantiles(df.limit(0), "x", WANTED).first()) == [None] * 5


def test_a_million_distinct_values_are_shared_out(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    seen = []
    real = quantile.stored

    def watched(rows, name):
        out = real(rows, name)
        if name == "ranged":
            seen.append(max(r["count"] for r in out.groupBy("_p").count().collect()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quantile, "stored", watched)
        got = quantile.quantiles(df, "x", {"p25": 0.25, "p50": 0.5}).first()
    want = np.quantile((np.arange(1_000_000) * 7919 % 1_000_003).astype(float), [0.25, 0.5])
    assert np.allclose([got.p25, got.p50], want) and seen[0] < 1_000_000 / 8
