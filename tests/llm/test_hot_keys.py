"""One key in a third of the rows: Spark can split the join that meets it."""

from contextlib import contextmanager

from matchloom.llm import graph, linededup, substring
from pyspark.sql import functions as F

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "6k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "6k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "24",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",  # else one small map task has all of the key
    "spark.sql.files.maxPartitionBytes": "256k",
}


@contextmanager
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, tmp_path, n=60_000):
    """A line in a third of all documents."""
    text = F.when(F.col("id") % 3 == 0, F.lit("this very line stands in a third of all the documents")).otherwise(F.concat(F.lit("a line of its own that no other document has at all "), "id"))
    spark.range(n).repartition(8).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_line_dedup(spark, tmp_path):
    with settings(spark):
        lost = linededup.dropped_keys(documents(spark, tmp_path))
        assert "skew=true" in plan(lost) and lost.count() == 20_000 - 1


def test_substring(spark, tmp_path):
    with settings(spark):
        units = substring.hashed_units(documents(spark, tmp_path), passage_words=None)
        units.write.parquet(str(tmp_path / "units"))
        met = substring._with_first(spark.read.parquet(str(tmp_path / "units")))
        assert "skew=true" in plan(met) and met.where("doc_id <> first_doc_id").count() == 20_000 - 1


def test_graph(spark, tmp_path):
    with settings(spark):
        edges = spark.range(1, 60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1).cast("long").alias("u"), F.col("id").alias("v"))
        edges.repartition(8).write.parquet(str(tmp_path / "edges"))
        assert "skew=true" in plan(graph._large_star(spark.read.parquet(str(tmp_path / "edges"))))
