"""Operator 8: contiguous shards of near equal bytes, by global prefix sums.

Rows are ordered by (doc_id, crc, size).  Equal rows are first counted together.  Ranges of doc_id, cut at STEP * STEP
approximate percentiles, form buckets; a doc_id that several cuts fall on is cut further, at as many ranges of crc, so
neither repeated rows nor many texts of one doc_id overload a bucket.  Rows without a doc_id are cut by crc likewise, in
proportion to their number.  A row that stands more than CHUNK times is made into rows again in chunks, dealt to all
tasks.  The buckets' totals, about three times STEP * STEP rows at most, are summed in order, and each bucket adds its own running sums.  A row whose middle byte lies at
position p of total T goes to shard p * n / T, so shards are contiguous in doc_id and differ by at most a row's size.

A null text has no bytes: its size is the overhead alone and its crc that of no bytes.  Null doc_ids come first.
Repeated rows each get a place of their own.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import table, written

#: STEP * STEP ranges of doc_id.
STEP = 32
#: Copies of one row that a task makes at once.
CHUNK = 10_000


def _bucket(cuts: list[int], col: str):
    """How many cuts lie below: a search in two steps."""
    if len(cuts) < STEP * STEP - 1:
        cuts = cuts + [2**63 - 1] * (STEP * STEP - 1 - len(cuts))
    every = F.array(*map(F.lit, cuts))
    coarse = F.array(*map(F.lit, cuts[STEP - 1 :: STEP]))
    first = F.size(F.filter(coarse, lambda c: c < F.col(col)))
    return first, lambda f: f * STEP + F.size(F.filter(F.slice(every, f * STEP + 1, STEP), lambda c: c < F.col(col)))


def bucketed(df: DataFrame, overhead: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, crc, n and bucket of the distinct rows of df; buckets follow each other as doc_id and crc do."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(doc).cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(raw, "utf-8")).alias("crc"),
    )
    share = [i / STEP**2 for i in range(1, STEP**2)]
    found, every, named = df.agg(F.percentile_approx(F.col(doc).cast("long"), share, 20 * STEP**2), F.count("*"), F.count(doc)).first()
    cuts = list(found or [])
    first, both = _bucket(cuts, "doc_id")
    equal = rows.groupBy("doc_id", "size", "crc").agg(F.count("*").alias("n"))
    equal = equal.withColumn("first", first)
    bucket = both(F.col("first")).cast("long") * (2 * STEP**2)
    if frequent := {d: n for d, n in Counter(cuts).items() if n > 1}:
        # In its bucket such a doc_id comes last, behind the smaller ones, as bucket numbers have it.
        parts = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in frequent.items() for x in pair)), F.col("doc_id"))
        bucket = bucket + F.when(parts.isNotNull(), 1 + F.shiftright(F.col("crc") * parts, 32)).otherwise(0)
    if every > named:
        # Behind which all others come.
        parts = -(-(every - named) * STEP**2 // every)
        nameless = F.shiftright(F.col("crc") * F.lit(parts).cast("long"), 32) - 2 * STEP**2
        bucket = F.when(F.col("doc_id").isNull(), nameless).otherwise(bucket)
    return equal.withColumn("bucket", bucket).drop("first")


def placed(df: DataFrame, overhead: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct rows of df, how often each stands there, and what rows and bytes come before it."""
    equal = bucketed(df, overhead, doc, text)
    totals = equal.groupBy("bucket").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    # One row a bucket: this window and the broadcast below do not grow with the data.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select(
        F.col("bucket").alias("of"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("bucket").orderBy("doc_id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = equal.select(
        "*",
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)).alias("bytes_in"),
    ).join(F.broadcast(starts), F.col("bucket") == F.col("of"))
    return rows.select(
        "doc_id", "size", "crc", "n", "all_bytes", (F.col("rows_before") + F.col("rows_in")).alias("first"), (F.col("bytes_before") + F.col("bytes_in")).alias("bytes")
    )


def spread(rows: DataFrame) -> DataFrame:
    """A row for each time that a row of placed() stands for, with its number, k."""
    rows = written(rows, "placed")
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    few = rows.where(F.col("n") <= CHUNK).select("*", F.explode(F.sequence(zero, last)).alias("k"))
    many = rows.where(F.col("n") > CHUNK).select("*", F.explode(F.sequence(zero, last, F.lit(CHUNK).cast("long"))).alias("start"))
    # Spark gathers a shuffle of few bytes in few tasks, unless it is told how many.
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "crc", "size", "start")
    many = many.select("*", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (CHUNK - 1), last))).alias("k"))
    return few.unionByName(many.drop("start"))


def sharded(df: DataFrame, n_shards: int = 24, overhead: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of df."""
    middle = 2 * (F.col("bytes") + F.col("k") * F.col("size")) + F.col("size")
    out = spread(placed(df, overhead, doc, text)).select("doc_id", "size", "crc", (F.col("first") + F.col("k")).alias("place"), middle.alias("middle"), "all_bytes")
    out = out.select("doc_id", "size", "crc", "place", F.expr(f"cast(middle * {n_shards} div (2 * all_bytes) as int)").alias("shard"))
    out = written(out, "sharded")
    # One row a shard.
    firsts = out.groupBy(F.col("shard").alias("at")).agg(F.min("place").alias("first_place"))
    return out.join(F.broadcast(firsts), F.col("shard") == F.col("at")).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
