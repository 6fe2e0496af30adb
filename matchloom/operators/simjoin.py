"""Similarity join of queries and documents on unit TF-IDF weights: all pairs from a threshold on, then each query's best.

Terms have one order, the rarest first.  A vector's prefix are its first terms, up to where what is left is shorter than
the threshold.  If a pair reaches the threshold, the first term the two share is in both prefixes: were it beyond one,
all they share would lie in that vector's rest, and the product with a unit vector is at most the rest's length.  So only
prefixes are joined, not vectors, and a frequent term stands in few of them.  Of the pairs that meet, two bounds drop more:

* by lengths: a product is at most the smaller number of terms times the two greatest weights;
* by the rest: what prefixes share, plus the longer of the two rests.

What is left is computed whole.  Queries without a pair are ranked against all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.index import TfidfIndex, joinable, query_weights, tfidf_index, unit_weights
from matchloom.operators.rank import DIGITS, best_of_reps, tfidf_by
from matchloom.sources.shared import stored

#: What rounding may do to a score or a length stays far below this.
EASE = 1e-5


def _prefixes(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, term, w, n, most (greatest weight) and rest (length of what is beyond the prefix) of each prefix's terms.
    vectors: key, term, df, w."""
    whole = Window.partitionBy(key)  # one vector
    before = whole.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("w") * F.col("w")
    rows = vectors.select(
        key, "term", "w", F.count("*").over(whole).alias("n"), F.max("w").over(whole).alias("most"),
        F.sum(square).over(whole).alias("all"), F.coalesce(F.sum(square).over(before), F.lit(0.0)).alias("before"),
    )
    rows = rows.where(F.col("all") - F.col("before") >= (threshold - EASE) ** 2)
    rest = F.sqrt(F.greatest(F.col("all") - F.max(F.col("before") + square).over(whole), F.lit(0.0)))
    return rows.select(key, "n", "most", rest.alias("rest"), "term", "w")


def candidates(asked: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """query_id and rep of all pairs that can reach the threshold.  asked: query_id, term, df, w; units: rep, term, df, w."""
    q, d = _prefixes(asked, "query_id", threshold), _prefixes(units, "rep", threshold)
    q = stored(q.toDF("query_id", "q_n", "q_most", "q_rest", "q_term", "q_w"), "query-prefixes")
    met = d.join(joinable(q), F.col("term") == F.col("q_term"))
    met = met.where(F.least("n", "q_n") * F.col("most") * F.col("q_most") >= threshold - EASE)
    pairs = met.groupBy("query_id", "rep").agg(F.sum(F.col("w") * F.col("q_w")).alias("shared"), F.max(F.greatest("rest", "q_rest")).alias("rest"))
    return pairs.where(F.col("shared") + F.col("rest") >= threshold - EASE).select("query_id", "rep")


def joined(asked: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """query_id, rep, first and score of all pairs that reach the threshold; and query_id and candidates, how many pairs
    were computed for it."""
    near = stored(candidates(asked, units, threshold), "candidates")
    counts = near.groupBy("query_id").agg(F.count("*").alias("candidates"))
    vectors = asked.select(F.col("query_id").alias("of_query"), F.col("term").alias("of_term"), F.col("w").alias("wq"))
    met = near.join(units, "rep").join(joinable(vectors), (F.col("query_id") == F.col("of_query")) & (F.col("term") == F.col("of_term")))
    scored = met.groupBy("query_id", "rep", "first").agg(F.round(F.sum(F.col("wq") * F.col("w")), DIGITS).alias("score"))
    return scored.where(F.col("score") >= threshold), counts


def best_match(queries: DataFrame, docs: DataFrame, terms_of, threshold: float = 0.9, text: str = "doc") -> tuple[DataFrame, DataFrame]:
    """query_id, ord and score of each query's first match, as rank.best_match() gives them; and the counts of joined()."""
    index: TfidfIndex = tfidf_index(docs, terms_of, text)
    df = index.terms.select(F.col("term").alias("df_term"), "df")
    with_df = lambda rows: rows.join(joinable(df), F.col("term") == F.col("df_term")).drop("df_term")
    units = stored(with_df(unit_weights(index)), "units")
    asked = stored(with_df(query_weights(queries, index.terms, terms_of, text).withColumnRenamed("wq", "w")), "asked")
    scored, counts = joined(asked, units, threshold)
    found = stored(best_of_reps(scored, index.copies, 1).drop("rank"), "matched")
    rest = stored(queries.join(joinable(stored(found.select("query_id"), "done")), "query_id", "left_anti"), "rest")
    if rest.limit(1).count():
        found = found.unionByName(tfidf_by(index, rest, docs, terms_of, 1, text).drop("rank"))
    return found, counts
