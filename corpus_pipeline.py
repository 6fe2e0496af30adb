"""The corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents, whatever they are
called besides doc_id and text; n_chars, where there is one, follows the text.

A null text counts as an empty one, and the quality rules reject it.  A null doc_id neither drops nor loses lines, is
near to nothing and is packed.  Rows that share a doc_id are one document to the line and near dedup: they lose the same
lines, and all stay or all go.  Ties go to the least doc_id among near copies and to the largest among line holders.
An empty table gives no pieces.  Very long texts are whole in one row and cut into pieces by packing alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import linededup, neardup, packing, pii, quality
from matchloom.llm.common import table
from matchloom.sources.shared import new_path, own_tables, remove

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", neardup.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Sketches, transducers and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with own_tables() as own:  # another thread's are not this run's to remove
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, f"pipeline-{name}")
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove(spark, before + [p for p in own if p != path])  # the predecessor, and what the stage wrote on its way
        before = [path]
    return docs
