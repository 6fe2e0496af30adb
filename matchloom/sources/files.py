"""CSV and JSON in and out, Markdown reports, and a content-addressed store of embeddings.

All paths go through Spark's readers and writers, so any store that Spark reaches will do; only reports, which are small,
are rendered on the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import stored

CATALOGUE = "product_id string, product_name string, brand_name string"
LABELLED = "text string, matched_id string"
DETAILS = "text string, gold_id string, gold_name string, top5 array<struct<id: string, name: string, score: double>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every column a string: product codes keep their leading zeros.  Quoted fields may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, for all tasks: Spark reads a small file, or a large one of one piece, in few splits.  Where these
    are less than half the cores, the rows are dealt out, so what is shuffled is a few splits at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CATALOGUE)


def read_labelled(spark: SparkSession, folder: str, split: str = "val") -> DataFrame:
    """Queries of a split, val or test, with their product ids."""
    return read_csv(spark, f"{folder}/queries_{split}.csv", LABELLED)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_details(details: DataFrame, path: str) -> None:
    """Rankings with their first matches, one JSON object a line."""
    details.write.mode("overwrite").json(path)


def read_details(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Details by line, or from files that are one JSON array each."""
    return spark.read.schema(DETAILS).option("multiLine", array).json(path)


def markdown(df: DataFrame, columns: dict[str, str]) -> str:
    """A table of all rows, rendered on the driver; columns: names to headings."""
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    for r in df.select(*columns).collect():
        lines.append("| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |")
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as a one-file text dataset."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def content_key(docs: DataFrame, model: str, text: str = "doc") -> str:
    """A key of all texts and the model's name that does not depend on the order of rows."""
    row = docs.agg(F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), F.col(text)).cast("decimal(38,0)")))
    return hashlib.md5("|".join(map(str, [*row.first(), model])).encode(), usedforsecurity=False).hexdigest()[:12]


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has come to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached_embeddings(docs: DataFrame, model: str, encode, folder: str, text: str = "doc") -> DataFrame:
    """encode(docs), read from the folder where the same texts were encoded by the same model before.  What a broken
    write has left is written anew."""
    spark, path = docs.sparkSession, f"{folder}/{content_key(docs, model, text)}"
    if not _whole(spark, path):
        encode(docs).write.mode("overwrite").parquet(path)
        if not _whole(spark, path):  # a committer that leaves no marker
            spark.createDataFrame([("whole",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_SUCCESS")
    return spark.read.parquet(path)


def stored_embeddings(docs: DataFrame, model: str, encode, folder: str, text: str = "doc") -> DataFrame:
    """The vectors (v) of docs' distinct texts, from the folder's store of the model: a row a text, by digest.  Only texts
    that the store lacks are encoded, by encode(), and appended; one changed row of a catalogue costs one text.

    A null text has no row.  Files that a broken append has left hold whole rows, and what it has not written is lacking
    next time; what two writers have both appended counts once."""
    spark, path = docs.sparkSession, f"{folder}/{hashlib.md5(model.encode(), usedforsecurity=False).hexdigest()[:12]}"
    schema, digest = "digest binary, v array<float>", F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    texts = docs.where(F.col(text).isNotNull()).select(text).distinct().withColumn("digest", digest)

    def held() -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)

    # Numbers and digests alone are compared, and a store of any size is scanned by its column of digests.
    lacking = stored(texts.join(held().select(F.col("digest").alias("of")), F.col("digest") == F.col("of"), "left_anti"), "lacking")
    if lacking.limit(1).count():
        encode(lacking).select("digest", F.col("v").cast("array<float>").alias("v")).write.mode("append").parquet(path)
    found = texts.join(held().withColumnRenamed("digest", "of"), F.col("digest") == F.col("of")).groupBy("digest")
    return found.agg(F.first(text).alias(text), F.first("v").alias("v")).select(text, "v")
