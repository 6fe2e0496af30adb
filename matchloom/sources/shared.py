"""Tables that are computed once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables this driver has written and not yet removed.
_TABLES: list[str] = []
#: The list that own_tables() keeps for this thread.
_OWN: ContextVar[list | None] = ContextVar("own_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="matchloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends, if no one removes it before."""
    if not _TABLES:
        atexit.register(remove_all, spark)
    _TABLES.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    if (own := _OWN.get()) is not None:
        own.append(_TABLES[-1])
    return _TABLES[-1]


@contextmanager
def own_tables():
    """The list of the paths that this thread, and no other, is given from here on."""
    outer, own = _OWN.get(), []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        if outer is not None:
            outer.extend(own)


def remove(spark: SparkSession, paths) -> None:
    """Removes tables that no DataFrame in use reads."""
    for path in paths:
        if path in _TABLES:
            _TABLES.remove(path)
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112: the session may have ended, and a table left behind does no harm
            continue


def remove_all(spark: SparkSession) -> None:
    remove(spark, list(_TABLES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again; a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
