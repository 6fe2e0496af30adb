"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import stored as written  # noqa: F401: the operators' name for it

#: The white space that all contracts of this subpackage name: blank and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all others of docs as one, row: no name that an operator uses can clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in columns]
    return docs.select(*columns, F.struct(*others, F.lit(True).alias(fresh(docs, "some"))).alias("row"))


def restored(out: DataFrame, docs: DataFrame, carried_beside: tuple, **changed) -> DataFrame:
    """out, which has row and the columns that were carried beside it, with the columns of docs, some of them changed."""
    own = {c: F.col(c) if c in carried_beside else F.col("row").getField(c) for c in docs.columns}
    return out.select(*(changed.get(c, own[c]).alias(c) for c in docs.columns))


#: Ids that are broadcast at most: 8 MB of longs.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, on: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of df with the one column of ids, a written table.  Few ids, which are counted first, are
    broadcast, so that the texts stay where they are; more are joined by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    name = fresh(df, "_of_id")
    ids = ids.toDF(name)
    return df.join(F.broadcast(ids) if few else ids, F.col(on) == F.col(name), how)


def afresh(key):
    """A long or binary key, unchanged.  In a join, a side that was aggregated by its own key stays as it is dealt, and
    then Spark can't split what the other side has of a frequent key; with this one it deals both sides, and can."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def afresh_binary(key):
    return F.concat(key, F.lit(b""))


class Sent:
    """A value sent to the workers once, and what each worker makes of it, kept over its tasks until the next one."""

    def __init__(self, spark: SparkSession, kind: str, value):
        self.kind, self.key = kind, uuid.uuid4().hex
        self.value = spark.sparkContext.broadcast(value)

    def made(self, build):
        # Functions travel by value, globals and all: what is to outlast a task needs a module of the worker's own.
        kept = sys.modules.setdefault("_matchloom_worker", types.ModuleType("_matchloom_worker")).__dict__.setdefault("kept", {})
        if self.kind not in kept or kept[self.kind][0] != self.key:
            kept.clear()  # what other operators' tasks have left in this worker
            kept[self.kind] = (self.key, build(self.value.value))
        return kept[self.kind][1]


def trimmed() -> None:
    """What a Python worker has freed goes back to the system: workers live on, and others need the memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def ascii_lower(col):
    """A-Z to a-z, all else as it is.  lower() does the same for pure ASCII, and faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, A_TO_Z, A_TO_Z.lower())
    )


def arrow_map(df: DataFrame, fn, schema: str, rows: int = 512) -> DataFrame:
    """fn(*columns as lists) -> columns as lists, over slices of at most `rows` rows, so that memory follows the slice
    and not the partition.  Integers stay integers where a column has nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, target)], schema=target)
        trimmed()

    return df.mapInArrow(run, schema)
