"""Few distinct documents that stand for many rows: dealt to all tasks, and scored once."""

import pytest
from matchloom.functions import text as T
from matchloom.operators import index, rank
from matchloom.plans import catalog
from pyspark.sql import functions as F

def names():
    return F.concat(F.lit("nome "), (F.col("id") % 40).cast("string"))


def recorded(monkeypatch, *modules):
    """Rows of each stored table, by name."""
    rows = {}
    for m in modules:
        plain = m.stored

        def kept(df, name, plain=plain):
            out = plain(df, name)
            rows.setdefault(name, []).append(out.count())
            return out

        monkeypatch.setattr(m, "stored", kept)
    return rows


def test_few_texts_of_many_rows_are_dealt_out(spark):
    docs = spark.range(1_000_001).select(F.col("id").alias("ord"), names().alias("doc"))
    one = index.shared(index.keyed(docs, "doc", index.rep_of(F.col("doc"))), "doc").withColumn("at", F.spark_partition_id())
    rows = one.collect()
    assert sorted(r.first for r in rows) == list(range(40)) and sum(r.copies for r in rows) == 1_000_001
    assert len({r.at for r in rows}) > 1


@pytest.mark.parametrize("terms", [T.char_wb, catalog.word_pairs])
def test_queries_meet_few_texts_of_many_rows_in_many_tasks(spark, terms):
    named = F.concat(F.lit("nome "), (F.col("id") % 40 + 10).cast("string")).alias("doc")
    docs = spark.range(1_000_001).select(F.col("id").alias("ord"), named)
    made = index.tfidf_index(docs, terms)
    at = made.counts.select("rep", F.spark_partition_id().alias("at")).distinct().groupBy("at").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in at) == 40 and len(at) > 1 and max(r.n for r in at) < 40
    asked = spark.range(3).select(F.col("id").alias("query_id"), named)
    found = rank.tfidf_by(made, asked, docs, terms, 2, pad=False).select("query_id", "rank", "ord").collect()
    assert sorted(map(tuple, found)) == [(q, i + 1, q + 40 * i) for q in range(3) for i in range(2)]


def test_bm25_scores_a_list_of_tokens_once(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("ord"), F.split(names(), " ").alias("tokens"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.split(names(), " ").alias("tokens"))
    rows = recorded(monkeypatch, rank)
    found = rank.bm25(asked, docs, 3, pad=False).collect()
    assert rows["leads"][0] <= 20 * 40
    assert sorted((r.query_id, r["rank"], r.ord) for r in found) == [(q, i + 1, q + 40 * i) for q in range(20) for i in range(3)]


def test_equal_products_share_a_vector(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("ord"), names().alias("doc"))
    asked = spark.range(5).select(F.col("id").alias("query_id"), names().alias("doc"))
    rows = recorded(monkeypatch, catalog)
    ranked = catalog._dense_and_hybrid(asked, docs, 2)
    assert rows["v"] == [40]
    for r in ranked.values():
        assert sorted((x.query_id, x["rank"], x.ord) for x in r.collect()) == [(q, i + 1, q + 40 * i) for q in range(5) for i in range(2)]


def test_postings_of_frequent_terms_are_not_shuffled(spark, monkeypatch):
    texts = ["a a b c", "a b", None, "", "a d e e e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").withColumn("tokens", F.split("text", " "))
    whole = sorted(index.bm25_index(docs).postings.collect())
    assert [(r.term, r.ord, r.tf, r.dl) for r in whole][:3] == [("", 3, 1, 1), ("a", 0, 2, 4), ("a", 1, 1, 2)] and len(whole) == 9
    monkeypatch.setattr(index, "BROADCAST_TERMS", 2)  # a and b; the others go by a shuffle
    built = index.bm25_index(docs)
    often, others, rest = index.frequent(built.terms)
    assert {r.term for r in often.collect()} == {"a", "b"} and others.count() == rest == 4
    assert sorted(built.postings.collect()) == whole


def test_tfidf_weights_of_frequent_terms_stay(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(["a b c", "a b", "a d c", "a b e", "f"])), "ord long, doc string")
    split = lambda c: F.split(c, " ")
    whole = sorted(rank.tfidf(docs.select(F.col("ord").alias("query_id"), "doc"), docs, split, 3).collect())
    monkeypatch.setattr(index, "BROADCAST_TERMS", 1)  # a; b and c go by a shuffle, the others have one document each
    built = index.tfidf_index(docs, split)
    often, _, rest = index.frequent(built.terms.where("df > 1"))
    assert [r.term for r in often.collect()] == ["a"] and rest == 2
    assert sorted(rank.tfidf(docs.select(F.col("ord").alias("query_id"), "doc"), docs, split, 3).collect()) == whole


def test_texts_stay_and_candidates_alone_meet_vectors(spark, tmp_path, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(7) if i != 4], "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = spark.range(60).select(F.col("id").alias("ord"), F.concat_ws(" ", names(), names()).alias("text"))
    asked = spark.createDataFrame([(1, ["nome", "3"], [1.0, 2.0]), (2, ["7"], [2.0, 1.0])], "query_id long, tokens array<string>, q array<float>")
    monkeypatch.setattr(index, "BROADCAST_TERMS", 50)  # fewer than documents, more than candidates
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = catalog._with_vectors(spark, str(tmp_path), docs, "ord", None)
        assert "Exchange hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()
        met = []

        def vectors_of(rows):
            met.append(rows.count())
            return catalog._with_vectors(spark, str(tmp_path), rows, "ord", "v", few=True)

        split = lambda c: F.split(c, " ")
        found = rank.hybrid(asked, held, 3, 5, pad=False, text="text", tokens_of=split, vectors_of=vectors_of).collect()
        whole = catalog._with_vectors(spark, str(tmp_path), docs, "ord", "v")
        assert sorted(found) == sorted(rank.hybrid(asked, whole, 3, 5, pad=False, text="text", tokens_of=split).collect()) and len(found) >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert met[0] <= 10
