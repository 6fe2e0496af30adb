"""Operator 10: corpus-wide line dedup.

A text is split at line feeds; a line's key is the line without white space at its ends, A-Z in lower case.  Keys of at
least min_chars code points that stand in at least min_docs distinct documents are dropped everywhere but in the
document with the largest id that holds them; all other lines stay, joined by line feeds in their old order.

Lines are exploded and hashed (128 bits), pairs of digest and document are made distinct before they are counted, and
only digests travel back: a document learns the set of digests it must drop and applies it to its own lines.

Null and empty texts are one empty line.  Rows that repeat a doc_id count as one document, and each of them drops the
same keys.  Rows with a null doc_id are not counted and stay whole.  An empty table gives an empty one; extra columns
are carried along, but for _n_lines and _n_dropped, which deduplicated() replaces; stage() keeps those too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, afresh_binary, ascii_lower, carried, fresh, restored, table


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _digest(key: Column) -> Column:
    # Not null, so that no filter on one side of the join keeps Spark from using an exchange twice.
    return F.coalesce(F.unhex(F.md5(key)), F.lit(b""))


def _byte(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int")


#: Dropped keys of a document that are looked up one by one.
MANY = 256


def dropped_keys(df: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and drop: the digests of the keys that each document loses."""
    lines = df.select(F.col(doc).alias("doc"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    keyed = lines.select("doc", line_key(F.col("line")).alias("key"))
    pairs = keyed.where((F.length("key") >= min_chars) & F.col("doc").isNotNull())
    pairs = pairs.select("doc", _digest(F.col("key")).alias("digest")).distinct()
    hot = pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    hot = hot.select(F.col("digest").alias("of"), "last")
    lost = pairs.join(hot, F.col("digest") == afresh_binary(F.col("of"))).where(F.col("doc") < F.col("last"))
    return lost.groupBy("doc").agg(F.collect_list("digest").alias("drop"))


def deduplicated(df: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its text reduced, and _n_lines and _n_dropped."""
    of, gone, every, left, lists = (fresh(df, n) for n in ("_drop_doc", "_drop", "_all", "_kept", "_lists"))
    drop = dropped_keys(df, min_chars, min_docs, doc, text).select(F.col("doc").alias(of), F.col("drop").alias(gone))
    kept_columns = [c for c in df.columns if c not in ("_n_lines", "_n_dropped")]
    df = df.select(*(F.col(f"`{c}`") for c in kept_columns))
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    joined = df.join(drop, F.col(doc) == F.col(of), "left").withColumn(every, lines)

    # A document that loses many keys has them in 256 lists by first byte, as each of its lines is looked up.
    parts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.filter(gone, lambda g: _byte(g) == i))
    joined = joined.withColumn(lists, F.when(F.size(gone) > MANY, parts))

    def stays(line: Column) -> Column:
        key = line_key(line)
        digest = _digest(key)
        few = F.array_contains(gone, digest)
        held = F.when(F.col(lists).isNull(), few).otherwise(F.array_contains(F.get(lists, _byte(digest)), digest))
        return (F.length(key) < min_chars) | ~held

    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), F.col(every)).otherwise(F.filter(every, stays)))
    return joined.select(
        *(F.array_join(left, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in kept_columns),
        F.size(every).cast("long").alias("_n_lines"),
        (F.size(every) - F.size(left)).cast("long").alias("_n_dropped"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines gone and n_chars brought up to date; a null text becomes an empty one."""
    out = deduplicated(carried(docs, "doc_id", "text"))
    return restored(out, docs, ("doc_id", "text"), n_chars=F.length("text").cast("long"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)
),
hot AS (
  SELECT k, max(doc_id) AS last FROM x WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
y AS (
  SELECT x.*, hot.k IS NOT NULL AND x.doc_id < hot.last AS dropped FROM x LEFT JOIN hot ON x.k = hot.k
)
SELECT doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (WHERE dropped))::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM y GROUP BY doc_id
"""
