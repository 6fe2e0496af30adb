"""Embedding providers: anything that adds a column of unit vectors to a DataFrame of texts."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def unit(vector: Column) -> Column:
    """A vector of length one; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vector)


def from_column(df: DataFrame, vector: str = "embedding", out: str = "v") -> DataFrame:
    """Vectors that a table brings along."""
    return df.withColumn(out, unit(F.col(vector)))


def hashed(df: DataFrame, key: str, terms: Column, out: str = "v", size: int = 64) -> DataFrame:
    """key and out: unit vectors of hashed terms, without a model and without Python.  A term adds 1 or -1, by its digest,
    to one component; rows without terms have the zero vector.  key is unique.  The terms are summed up where they are read:
    one row a key is shuffled, whatever the length of its text."""
    each = df.select(key, F.explode_outer(terms).alias("_term"))
    hash_of = F.conv(F.substring(F.md5("_term"), 1, 4), 16, 10).cast("int")
    each = each.select(key, (hash_of % size).alias("_at"), F.when(F.floor(hash_of / size) % 2 == 0, 1).otherwise(-1).alias("_sign"))
    sums = [F.coalesce(F.sum(F.when(F.col("_at") == i, F.col("_sign"))), F.lit(0)).alias(f"_{i}") for i in range(size)]
    vectors = each.groupBy(key).agg(*sums)
    return vectors.select(key, unit(F.array(*(F.col(f"_{i}").cast("float") for i in range(size)))).alias(out))


def from_model(
    df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "doc", out: str = "v", batch: int = 256, chars: int = 200_000, name: str | None = None
) -> DataFrame:
    """Vectors of a model.  load() returns a function of a list of texts, and is called once in a Python worker, which keeps
    the model over its tasks until another one is asked for; under the same name later calls find it there too.  Texts
    reach the model in lists of at most batch texts and, but for a single longer text, chars characters."""
    key = name or uuid.uuid4().hex

    @pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # What is to outlast a task needs a module of the worker's own: this function comes anew with each.
        kept = sys.modules.setdefault("_matchloom_model", types.ModuleType("_matchloom_model")).__dict__
        if kept.get("key") != key:
            kept.pop("model", None)  # two do not stand beside each other
            kept.update(model=load(), key=key)
        model = kept["model"]
        for part in parts:
            found, some, size = [], [], 0
            for t in part:
                t = t or ""
                if some and (len(some) == batch or size + len(t) > chars):
                    found += model(some)
                    some, size = [], 0
                some.append(t)
                size += len(t)
            yield pd.Series(found + (list(model(some)) if some else []))

    return from_column(df.withColumn(out, encode(F.col(text))), out, out)
