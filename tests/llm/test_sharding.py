import zlib

from matchloom.llm import sharding as S
from pyspark.sql import functions as F
from tests.llm import docs


def check(rows, data, n):
    assert len(rows) == len(data)
    want = sorted((d if d is not None else -1, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in data)
    total, at, place = sum(s for _, _, s in want), 0, {}
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id if r.doc_id is not None else -1, r.text_crc32, r.size) for r in ordered] == want
    for r in ordered:
        assert r.shard == (2 * at + r.size) * n // (2 * total)
        assert r.slot == place.get(r.shard, 0)
        place[r.shard] = r.slot + 1
        at += r.size


def test_contiguous_and_balanced(spark):
    data = [(d, t) for d, t, *_ in docs.rows()]
    check(S.sharded(docs.frame(spark), 24).collect(), data, 24)
    check(S.sharded(docs.frame(spark), 3).collect(), data, 3)


def test_hot_id_nulls_and_ties(spark):
    data = [(7, "same")] * 500 + [(i, "t" * (i % 9)) for i in range(300)] + [(None, None), (None, "x"), (7, "other")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    check(S.sharded(df, 6).collect(), data, 6)


def test_many_texts_of_one_id_are_dealt_to_many_buckets(spark):
    data = [(7 if i % 3 == 0 else i, "t" * (i % 50) + str(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    check(S.sharded(df, 24).collect(), data, 24)
    assert S.bucketed(df).groupBy("bucket").count().agg({"count": "max"}).first()[0] < 40


def test_empty_and_extra_columns(spark):
    assert S.sharded(docs.empty(spark)).count() == 0
    df = docs.frame(spark).withColumnRenamed("lang", "shard").withColumnRenamed("source", "size")
    assert S.sharded(df).count() == len(docs.rows())


def test_a_third_without_ids_is_dealt_to_many_buckets(spark):
    data = [(None if i % 3 == 0 else i, "t" * (i % 50) + str(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    check(S.sharded(df, 24).collect(), data, 24)
    assert S.bucketed(df).groupBy("bucket").count().agg({"count": "max"}).first()[0] < 40


def test_a_repeated_row_is_made_again_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 100)
    data = [(7, "same")] * 4000 + [(None, "x")] * 1999 + [(i, str(i)) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    check(S.sharded(df, 24).collect(), data, 24)
    made = S.spread(S.placed(df)).where("doc_id = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 2 and max(r["count"] for r in made) < 3000
