"""Quality of rankings and of scores."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.quantile import quantiles
from matchloom.sources.shared import stored


def first_hits(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id and hit, the rank of the gold document within the first k, or null.  ranked: query_id, rank, ord;
    gold: query_id, gold.  Queries without any ranking count."""
    hit = F.min(F.when((F.col("ord") == F.col("gold")) & (F.col("rank") <= k), F.col("rank"))).alias("hit")
    return gold.join(ranked.select("query_id", "rank", "ord"), "query_id", "left").groupBy("query_id").agg(hit)


def _measures() -> list[Column]:
    return [
        F.avg(F.when(F.col("hit") == 1, 1.0).otherwise(0.0)).alias("p1"),
        F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0)).alias("recall"),
        F.count("*").alias("n"),
    ]


def metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """p1, mrr, recall and n in one row; null measures where there is no query."""
    return first_hits(ranked, gold, k).agg(*_measures())


def evaluate(rank, queries: DataFrame, gold: DataFrame, k: int = 5) -> tuple[dict, DataFrame]:
    """Measures of a ranker over all queries, with the seconds it took, and its ranking."""
    began = time.perf_counter()
    ranked = stored(rank(queries, k), "ranked")
    measured = metrics(ranked, gold, k).first().asDict()
    return measured | {"seconds": round(time.perf_counter() - began, 2)}, ranked


def compared(results: dict[str, DataFrame], gold: DataFrame, k: int = 5) -> DataFrame:
    """A row of measures, rounded to three digits, per named ranking; a ranking without queries has n 0."""
    names = gold.sparkSession.createDataFrame([(n,) for n in results], "method string")
    rows = [r.select(F.lit(n).alias("method"), "query_id", F.when(F.col("rank") <= k, F.col("rank")).alias("rank"), "ord") for n, r in results.items()]
    met = reduce(DataFrame.unionByName, rows).join(gold, "query_id").where(F.col("ord") == F.col("gold"))
    hits = met.groupBy("method", "query_id").agg(F.min("rank").alias("hit"))
    totals = hits.groupBy("method").agg(
        F.count(F.when(F.col("hit") == 1, 1)).alias("first"), F.sum(1.0 / F.col("hit")).alias("mrr"), F.count("hit").alias("recall")
    )
    n = gold.agg(F.count("*").alias("n"))
    share = [F.round(F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.col("n")), 3).alias(o) for c, o in (("first", "p1"), ("mrr", "mrr"), ("recall", "recall"))]
    return names.withColumn("n", n.scalar()).join(totals, "method", "left").select("method", *share, "n")


def score_stats(scores: DataFrame, *by: str, column: str = "score") -> DataFrame:
    """n, mean, p5 (linear between ranks), min and max."""
    scores = stored(scores.select(*by, column), "scores")
    plain = scores.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return _beside(plain, quantiles(scores, column, {"p5": 0.05}, *by), by).select(*by, "n", "mean", "p5", "min", "max")


def described(scores: DataFrame, column: str = "score") -> DataFrame:
    scores = stored(scores.select(column), "scores")
    plain = scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    wanted = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return _beside(plain, quantiles(scores, column, wanted), ()).select("n", "mean", "std", "min", *wanted, "max")


def _beside(plain: DataFrame, more: DataFrame, by: tuple) -> DataFrame:
    """The rows of both, by group; one each where there are no groups."""
    names = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] or [F.col("a._one") == F.col("b._one")]
    one = F.lit(1).alias("_one")
    met = plain.select("*", one).alias("a").join(more.select("*", one).alias("b"), names)
    return met.select("a.*", *(F.col(f"b.{c}") for c in more.columns if c not in by))


def below_thresholds(scores: DataFrame, thresholds, column: str = "score") -> DataFrame:
    """How many scores lie below each threshold, and their share, in one pass."""
    counts = [F.count_if(F.col(column) < t).alias(f"c{i}") for i, t in enumerate(thresholds)]
    row = scores.agg(F.count("*").alias("n"), *counts)
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n_below")) for i, t in enumerate(thresholds)))
    return row.select("n", F.explode(each).alias("t")).select(
        "t.threshold", "t.n_below", F.try_divide(F.col("t.n_below").cast("double"), F.col("n")).alias("share")
    )


def rejected(matches: DataFrame, threshold: float, match: str = "matched_id") -> DataFrame:
    """matches with those below the threshold set to null."""
    return matches.withColumn(match, F.when(F.col("score") >= threshold, F.col(match)))


def hit_flag(rank: Column, doc: Column, gold: Column) -> Column:
    return (rank == 1) & (doc == gold)
