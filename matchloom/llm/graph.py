"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Ids are longs.  Repeated edges, loops and edges with a null end count for nothing; without edges the result is empty.
Of the edge table only the two named columns are read, so others may have any name.  Every round is a written table; the
least neighbours are partial aggregates, and their join deals both sides, so that Spark can split a hub's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import afresh, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each u and its neighbours; partial minima are taken before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("of", "low").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    out = pairs.join(_least(pairs), F.col("u") == afresh(F.col("of"))).where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == afresh(F.col("of")))
    out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").where("u <> v").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) of every node that has an edge to another one."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()  # nulls differ from nothing
    edges = written(edges, "edges")
    before = _mark(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
