"""Exact quantiles by distributed selection: no group's values ever stand in one buffer.

Values are counted, and the counted values are cut into ranges, which are written.  From the ranges' totals follows in
which one a wanted rank lies; only those ranges are summed up value by value, each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.shared import stored

#: Ranges that values are cut into at most, beside those that Spark's number of shuffle partitions gives.
RANGES = 32


def quantiles(df: DataFrame, column: str, wanted: dict[str, float], *by: str) -> DataFrame:
    """by and, for each name of wanted, its quantile, linear between ranks.  Nulls don't count; a group without values has
    nulls, and without by there is one row in any case."""
    spark = df.sparkSession
    parts = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(1).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*keys, F.col(column).cast("double").alias("_v"))
    counts = rows.groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    # Written with the number of its range, which else might change whenever it is made anew.
    ranged = counts.repartitionByRange(parts, *names, "_v").withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    every = ranged.groupBy(*names).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_all"))
    ranged = ranged.where("_v IS NOT NULL")
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = ranged.groupBy(*names, "_p").agg(F.sum("_n").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted.items()))).alias("_w")
    ranks = every.where("_all > 0").select(*names, asked, "_all").withColumn("_at", F.col("_w.q") * (F.col("_all") - 1))
    ranks = ranks.select(*names, F.col("_w.name").alias("_name"), "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_r")).distinct()
    same = lambda a, b: [a[n].eqNullSafe(b[n]) for n in names]
    met = ranks.join(totals, [*same(ranks, totals), F.col("_r") >= F.col("_b"), F.col("_r") < F.col("_b") + F.col("_t")])
    place = stored(met.select(*(ranks[n] for n in names), "_p", "_name", "_at", "_r", (F.col("_r") - F.col("_b")).alias("_i")), "places")
    needed = place.select(*names, "_p").distinct()
    inside = ranged.join(needed, [*same(ranged, needed), ranged["_p"] == needed["_p"]], "left_semi")
    within = Window.partitionBy(*names, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_c", F.sum("_n").over(within))
    hit = place.join(inside, [*same(place, inside), place["_p"] == inside["_p"], F.col("_i") >= F.col("_c") - F.col("_n"), F.col("_i") < F.col("_c")])
    hit = hit.select(*(place[n] for n in names), "_name", "_at", "_r", "_v")
    low, high = F.min_by("_v", "_r"), F.max_by("_v", "_r")
    value = F.when(F.min("_r") == F.max("_r"), low).otherwise((F.max("_r") - F.first("_at")) * low + (F.first("_at") - F.min("_r")) * high)
    each = hit.groupBy(*names, "_name").agg(value.alias("_q"))
    wide = each.groupBy(*names).agg(*(F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in wanted))
    if not by:
        one = spark.range(1).select(F.lit(1).alias("_one"))
        return one.join(wide, F.col("_one") == F.col("_k0"), "left").select(*wanted)
    out = every.join(wide, same(every, wide), "left").select(*(every[n] for n in names), *wanted)
    return out.toDF(*by, *wanted)
