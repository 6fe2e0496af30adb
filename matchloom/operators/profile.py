"""Profiles of tables and texts.  Equal counts are ordered by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.tables import PACK_TOKEN_PATTERN
from matchloom.operators.quantile import quantiles
from matchloom.sources.shared import stored


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns))


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def all_null(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.bool_and(F.col(column).isNull()), F.lit(True))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that several rows have: a semi join with counted keys, so a frequent key fills no window."""
    many = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(many, key, "left_semi")


def duplicate_groups(df: DataFrame, key: str, member: str, first: int = 5) -> DataFrame:
    """The first keys that several rows have: key, n, the number of its rows, and a row for each member."""
    kept = duplicated(df, key)
    counts = kept.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).limit(first)
    return kept.join(F.broadcast(counts), key).select(key, "n", F.col(member).alias("member"))


def top_values(values: DataFrame, column: str, first: int) -> DataFrame:
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(first)


def first_word(col: Column) -> Column:
    return F.lower(F.get(F.split(F.trim(col), r"\s+"), F.lit(0)))


def lengths(df: DataFrame, text: str) -> DataFrame:
    chars, tokens = F.char_length(text), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    sized = stored(df.where(F.col(text).isNotNull()).select(chars.alias("chars"), tokens.alias("tokens")), "sized")
    names = [f"{n}_{c}" for c in ("chars", "tokens") for n in ("min", "median", "max")]
    ends = sized.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("chars", "tokens") for n, f in (("min", F.min), ("max", F.max))), F.lit(1).alias("_a"))
    middle = [quantiles(sized, c, {f"median_{c}": 0.5}).withColumn(f"_{c}", F.lit(1)) for c in ("chars", "tokens")]
    return ends.join(middle[0], F.col("_a") == F.col("_chars")).join(middle[1], F.col("_a") == F.col("_tokens")).select(*names)


def upper_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.upper(F.col(text)), F.lit(r"\S+"), F.lit(0))).alias("token"))


def pack_tokens(df: DataFrame, text: str, whole: bool = True) -> DataFrame:
    """Pack tokens that fill a token, or that stand between word boundaries anywhere."""
    if whole:
        return upper_tokens(df, text).where(F.col("token").rlike(f"^(?:{PACK_TOKEN_PATTERN})$"))
    pattern = rf"\b(?:{PACK_TOKEN_PATTERN})\b"
    return df.select(F.explode(F.regexp_extract_all(F.upper(F.col(text)), F.lit(pattern), F.lit(0))).alias("token"))


def label_cover(labelled: DataFrame, catalogue: DataFrame, label: str, key: str) -> DataFrame:
    """How many labels are in the catalogue, empty, or outside it.  A null label is empty."""
    named = labelled.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    keys = catalogue.select(F.col(key).cast("string").alias("label")).distinct().withColumn("known", F.lit(True))
    known = F.coalesce(F.col("known"), F.lit(False))
    return named.join(keys, "label", "left").agg(
        F.count_if(known & (F.col("label") != "")).alias("inside"),
        F.count_if(F.col("label") == "").alias("empty"),
        F.count_if(~known & (F.col("label") != "")).alias("outside"),
    )


def outside(labelled: DataFrame, catalogue: DataFrame, label: str, key: str, first: int = 5) -> DataFrame:
    rows = labelled.where(F.coalesce(F.col(label).cast("string"), F.lit("")) != "")
    return rows.join(catalogue.select(F.col(key).alias(label)).distinct(), label, "left_anti").orderBy(label).limit(first)


def shared_texts(texts: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct texts that also stand in one of the others."""
    return reduce(DataFrame.union, [texts.intersect(o) for o in others]).distinct()


def upper_share(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return df.agg(F.avg(F.when((F.upper(t) == t) & (F.lower(t) != t), 1.0).otherwise(0.0)).alias("upper_share"))


def sample(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)
