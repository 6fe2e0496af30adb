"""What rankings get right and wrong: errors, diagnoses, ambiguity, rejected queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.tables import OTHER_PRODUCT, WRONG_SIZE, WRONG_VARIANT
from matchloom.functions.text import quantities, with_tokens
from matchloom.operators.profile import duplicated


def first_matches(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, gold, top, score and correct; a query without a ranking is an error."""
    first = ranked.where("rank = 1").select("query_id", F.col("ord").alias("top"), "score")
    correct = F.coalesce(F.col("top") == F.col("gold"), F.lit(False))
    return gold.join(first, "query_id", "left").withColumn("correct", correct)


def gold_positions(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id and the gold document's rank as text, ">k" where it is not among the first k."""
    at = F.min(F.when((F.col("ord") == F.col("gold")) & (F.col("rank") <= k), F.col("rank")))
    met = gold.join(ranked.select("query_id", "rank", "ord"), "query_id", "left").groupBy("query_id").agg(at.alias("at"))
    return met.select("query_id", F.coalesce(F.col("at").cast("string"), F.lit(f">{k}")).alias("position"))


def diagnosed(pairs: DataFrame, gold: str = "gold_name", found: str = "top_name") -> DataFrame:
    """pairs with a diagnosis of each wrong match, from the two names alone."""
    df = with_tokens(with_tokens(pairs, gold, "_g"), found, "_f")
    df = df.withColumn("_gt", F.array_distinct("_g")).withColumn("_ft", F.array_distinct("_f"))
    df = df.withColumn("_gq", quantities(F.array_join("_g", " "))).withColumn("_fq", quantities(F.array_join("_f", " ")))
    sizes_differ = (F.size(F.array_except("_gq", "_fq")) > 0) | (F.size(F.array_except("_fq", "_gq")) > 0)
    alike = F.size(F.array_intersect(F.array_except("_gt", "_gq"), F.array_except("_ft", "_fq"))) > 0
    common = F.size(F.array_intersect("_gt", "_ft"))
    least = F.greatest(F.lit(2), F.floor(F.size("_gt") / 2).cast("int"))
    verdict = F.when(sizes_differ & alike, WRONG_SIZE).when(common >= least, WRONG_VARIANT).otherwise(OTHER_PRODUCT)
    return df.withColumn("diagnosis", verdict).drop("_g", "_f", "_gt", "_ft", "_gq", "_fq")


def error_sets(one: DataFrame, two: DataFrame, by: str = "query_id") -> DataFrame:
    """by and side, of queries that ranker one, two or both got wrong.  one, two: by and correct.  By text, queries of the
    same text count once, and as wrong where one of them is."""
    a = one.groupBy(by).agg(F.bool_or(~F.col("correct")).alias("wrong_one"))
    b = two.groupBy(by).agg(F.bool_or(~F.col("correct")).alias("wrong_two"))
    both = a.join(b, by, "full_outer").na.fill(False, ["wrong_one", "wrong_two"])
    side = F.when(F.col("wrong_one") & F.col("wrong_two"), "both").when(F.col("wrong_one"), "only_one").when(F.col("wrong_two"), "only_two")
    return both.select(by, side.alias("side")).where("side IS NOT NULL")


def ambiguous(ranked: DataFrame, names: DataFrame, first: int = 8, margin: float = 0.01, digits: int | None = None) -> DataFrame:
    """The first queries whose best match has a name that others share, or whose first two scores nearly tie.
    names: ord and name.  digits rounds scores before they are compared."""
    shared = duplicated(names, "name").select("name").distinct().withColumn("dup", F.lit(True))
    pair = ranked.where("rank <= 2").join(names, "ord").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("name_1"),
        F.max(F.when(F.col("rank") == 2, F.col("name"))).alias("name_2"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    s1, s2 = (F.round(c, digits) if digits is not None else F.col(c) for c in ("s1", "s2"))
    pair = pair.where("s2 IS NOT NULL").withColumn("delta", F.round(s1 - s2, 6))
    pair = pair.join(shared.withColumnRenamed("name", "name_1"), "name_1", "left")
    dup = F.coalesce(F.col("dup"), F.lit(False)) | (F.col("name_1") == F.col("name_2"))
    found = pair.withColumn("duplicate_name", dup).where(dup | (F.col("delta") < margin))
    return found.select("query_id", "name_1", "name_2", "delta", "duplicate_name").orderBy("query_id").limit(first)


def nested(ranked: DataFrame, queries: DataFrame, gold: DataFrame, names: DataFrame, digits: int = 4) -> DataFrame:
    """text, gold_id, gold_name and top: an array of id, name and score, best first.  names: ord, id, name."""
    gold_names = names.select(F.col("ord").alias("gold"), F.col("id").alias("gold_id"), F.col("name").alias("gold_name"))
    entry = F.struct("rank", "id", F.coalesce("name", F.lit("?")).alias("name"), F.round("score", digits).alias("score"))
    tops = ranked.join(names, "ord", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    rows = queries.join(gold, "query_id", "left").join(gold_names, "gold", "left").join(tops, "query_id", "left")
    top = F.transform(F.coalesce("top", F.array()), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["score"].alias("score")))
    return rows.select("query_id", "text", "gold_id", F.coalesce("gold_name", F.lit("<FORA DO CATALOGO>")).alias("gold_name"), top.alias("top"))


def judged(rows: DataFrame, top: str = "top", k: int = 5) -> DataFrame:
    """rows of nested(), with found, score, correct, position (">k" beyond the first k) and, for errors, a diagnosis."""
    first = F.get(top, F.lit(0))
    at = F.array_position(F.transform(F.slice(top, 1, k), lambda x: x["id"]), F.col("gold_id"))
    seen = rows.select(
        *(c for c in rows.columns if c != top),
        first["name"].alias("found"), first["score"].alias("score"),
        F.coalesce(first["id"] == F.col("gold_id"), F.lit(False)).alias("correct"),
        F.when(at > 0, at.cast("string")).otherwise(F.lit(f">{k}")).alias("position"),
    )
    told = diagnosed(seen, "gold_name", "found")
    return told.withColumn("diagnosis", F.when(~F.col("correct"), F.col("diagnosis")))


def examples(rows: DataFrame, hits: int = 5) -> DataFrame:
    """The first hits, by query_id, and all errors, of judged rows."""
    first = rows.where("correct").orderBy("query_id").limit(hits)
    return first.unionByName(rows.where("NOT correct"))


def probe_table(ranked: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """query_id, and the names and scores of the first k, each joined into one text."""
    rows = ranked.where(F.col("rank") <= k).join(names, "ord", "left")
    entry = F.struct("rank", F.coalesce("name", F.lit("—")).alias("name"), F.format_string("%.3f", F.col("score")).alias("score"))
    tops = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    return tops.select(
        "query_id",
        F.array_join(F.transform("top", lambda x: x["name"]), "; ").alias("names"),
        F.array_join(F.transform("top", lambda x: x["score"]), "; ").alias("scores"),
    )


def probe_tables(ranked: dict[str, DataFrame], names: DataFrame, k: int = 3) -> DataFrame:
    """method, query_id, names and scores of several named rankings."""
    tables = [probe_table(r, names, k).withColumn("method", F.lit(n)) for n, r in ranked.items()]
    return reduce(DataFrame.unionByName, tables).select("method", "query_id", "names", "scores")


def near_ties(ranked: DataFrame, margin: float = 0.01) -> DataFrame:
    """query_id and delta of the first two scores, where it is below the margin."""
    ahead = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("delta", F.round(F.col("score") - ahead, 6)).where((F.col("rank") == 1) & (F.col("delta") < margin)).select("query_id", "delta")
