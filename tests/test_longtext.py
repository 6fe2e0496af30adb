"""TF-IDF over long texts: the ranking of rank.tfidf(), without a shuffle of all words and pairs."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import index, longtext, rank
from matchloom.plans import catalog
from matchloom.plans.catalog import word_pairs
from tests.test_copies import recorded

#: Places, bits and first documents so few that terms share places, the filter lets others pass and more norms are asked for.
FEW = {"PLACES": 16, "MARKS": 256, "BLOCK": 8, "FIRST": 1}


def few(monkeypatch, **more):
    for name, value in (FEW | more).items():
        monkeypatch.setattr(longtext, name, value)


def texts(n, words, vocabulary, seed=5):
    """Words of which some are common and most rare."""
    rng = random.Random(seed)
    return [" ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randint(1, words))) for _ in range(n)]


def frames(spark, docs, asked):
    # As documents and passages are told apart in the registry: no table is both.
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, doc string"), spark.createDataFrame(list(enumerate(docs)), "ord long, doc string")


@pytest.mark.parametrize("pad", [False, True])
def test_same_ranking(spark, monkeypatch, pad):
    few(monkeypatch)
    made = texts(160, 60, 90)
    docs = made + made[:30] + made[:3] * 5 + ["", "  ", None, "alone here"]
    asked = [" ".join(t.split()[:8]) for t in made[:20]] + ["nothing known", "", "alone", "w0 w0 w1 unheard", None]
    queries, catalogue = frames(spark, docs, asked)
    rounds, norms = [], longtext.norms
    monkeypatch.setattr(longtext, "norms", lambda *a: rounds.append(1) or norms(*a))
    found = sorted(longtext.tfidf(queries, catalogue, T.word_terms, T.with_bigrams, 5, pad=pad).collect())
    assert len(rounds) == 2 and found == sorted(rank.tfidf(queries, catalogue, word_pairs, 5, pad=pad).collect())


def test_no_documents(spark, monkeypatch):
    few(monkeypatch)
    queries, catalogue = frames(spark, ["some words"], ["some words"])
    assert longtext.tfidf(queries, catalogue.where("false"), T.word_terms, T.with_bigrams).collect() == []
    assert longtext.tfidf(queries.where("false"), catalogue, T.word_terms, T.with_bigrams).collect() == []


def test_bounds_hold(spark, monkeypatch):
    few(monkeypatch)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(80, 40, 60))], "row long, doc string").withColumn("words", T.word_terms(F.col("doc")))
    held = rows.select(F.explode(F.array_distinct(T.with_bigrams(F.col("words")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    least = F.get(longtext.least_idf(rows, T.with_bigrams, 80), longtext._place(longtext.PLACES).cast("int"))
    assert held.where(least.isNull() | (least > longtext._idf(80, F.col("df")))).count() == 0
    # With places enough, most terms have one of their own.
    few(monkeypatch, PLACES=1 << 16)
    least = F.get(longtext.least_idf(rows, T.with_bigrams, 80), longtext._place(longtext.PLACES).cast("int"))
    near = held.where(least > longtext._idf(80, F.col("df")) - 0.001).count()
    assert near > 0.9 * held.count()


def test_query_does_not_store_all_words_and_pairs(spark, monkeypatch, tmp_path):
    few(monkeypatch, PLACES=1 << 16, MARKS=1 << 20, FIRST=2)
    docs = texts(600, 1000, 40_000)
    queries, catalogue = frames(spark, docs, [" ".join(t.split()[:30]) for t in docs[:3]])
    catalogue.select(F.col("ord").alias("doc_id"), F.col("doc").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    queries.select(F.col("query_id").alias("item_id"), F.col("doc").alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted(rank.tfidf(queries, catalogue, word_pairs, 5, pad=False).collect())
    every = catalogue.select(F.explode(word_pairs(F.col("doc"))).alias("term")).distinct().count()
    rows = recorded(monkeypatch, index, rank, longtext)
    assert sorted(catalog.queries()["tfidf_word_top5"](spark, str(tmp_path)).collect()) == want
    assert max(n for counts in rows.values() for n in counts) < every / 4
