import random

import pytest
from matchloom.functions import text as T
from matchloom.operators import rank, simjoin
from pyspark.sql import functions as F

WORDS = ["suco", "uva", "laranja", "integral", "agua", "sem", "gas", "leite", "po", "mel", "cha", "1l", "2l", "500ml", "lata", "refrigerante"]


def frames(spark, seed=2):
    rng = random.Random(seed)
    docs = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["", "uva", "uva"]
    asked = [d[:-1] if i % 3 else d for i, d in enumerate(docs[:40])] + ["uva", "uva uva", "nada", "", "zzz leite"]
    d = spark.createDataFrame([(200 - i, x) for i, x in enumerate(docs)], "ord long, doc string")
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, doc string"), d.repartition(3)


def rows(df):
    return sorted((r.query_id, r.ord, r.score) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_best_matches_are_those_of_all_pairs(spark, threshold):
    asked, docs = frames(spark)
    found, counts = simjoin.best_match(asked, docs, T.char_wb, threshold)
    assert rows(found) == rows(rank.best_match(asked, docs, T.char_wb))
    assert 0 < counts.agg(F.sum("candidates")).first()[0] < asked.count() * docs.count() / 3


def test_join_finds_all_pairs_from_the_threshold(spark):
    from matchloom.operators import index

    asked, docs = frames(spark, 5)
    built = index.tfidf_index(docs, T.char_wb)
    df = built.terms.select("term", "df")
    units = index.unit_weights(built).join(df, "term")
    weights = index.query_weights(asked, built.terms, T.char_wb).withColumnRenamed("wq", "w").join(df, "term")
    got = {(r.query_id, r.rep, r.score) for r in simjoin.joined(weights, units, 0.5)[0].collect()}
    want = {(r.query_id, r.rep, r.score) for r in rank.tfidf_scores(asked, built, T.char_wb).where("score >= 0.5").collect()}
    assert got == want and len(got) > 40


def test_none(spark):
    asked, docs = frames(spark)
    assert simjoin.best_match(asked.limit(0), docs, T.char_wb)[0].count() == 0
    assert simjoin.best_match(asked, docs.limit(0), T.char_wb)[0].count() == 0
