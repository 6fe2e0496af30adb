"""Operator 3: exact top-k inner products by pivot-table elimination.

Components are turned into floor(256 x).  A table holds every vector's distances to PIVOTS pivots, chosen farthest
first among at most SAMPLE vectors.  By the triangle inequality the largest difference of a query's and a vector's
distances to one pivot is a lower bound on their distance, and so, with both norms, an upper bound on their inner
product.  Within a block of vectors, candidates are evaluated in the order of that bound, and evaluation stops as soon
as the next bound is below the k-th best score: the result is exact.  The bound is eased by far more than rounding errs.

The stated queries meet all rows in blocks: blocks of queries and blocks of vectors, each pair one task's group, of
which only k rows a query come back.  Blocks are dealt by a hash of the row, so their size is bounded, whatever repeats.
Every query starts with a threshold that holds for all blocks: its k-th best score among the vectors the pivots were
chosen from.  How much the bounds spare depends on the vectors; the operator counts it (column evaluated).

Every row is a candidate of every other: rows that repeat an id, a vector or both stand for themselves, a repeated query
row has a ranking of its own, and a query is no candidate of its own.  Blocks whose products may pass 2 ** 53 are scored
in whole integers without elimination; a component of 2 ** 54 or more, and a score beyond a long, raise an error.  Vectors that are null, empty, or hold a null or
non-finite component take no part, nor do rows without an id.  Queries meet vectors of their own length only.  Ties go
to the smaller id.  Without rows, or without queries, the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, arrow_map, table, written

PIVOTS, SAMPLE = 32, 1024
QUERY_BLOCK, VECTOR_BLOCK = 8192, 8192
#: What rounding may do to a difference of two distances stays far below this.
EASE = 1e-6
#: Sums of products below this are exact in doubles.
EXACT = 2**53


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal, from the vector of least norm."""
    chosen = [int(np.argmin((sample**2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def best_of_block(q, q_row, q_dist, least, v, v_row, v_id, v_dist, k: int):
    """For each query its k best of the block that reach its threshold: lists of query row, vector id and score, and of
    how many scores were computed."""
    v_norm, q_norm = (v**2).sum(1), (q**2).sum(1)
    out: tuple[list, ...] = ([], [], [], [])
    for at in range(0, len(q), 128):
        part = slice(at, at + 128)
        bound = np.zeros((len(q[part]), len(v)))
        for p in range(v_dist.shape[1]):
            np.maximum(bound, np.abs(q_dist[part, p][:, None] - v_dist[:, p][None, :]), out=bound)
        bound = (q_norm[part][:, None] + v_norm[None, :] - np.maximum(bound - EASE, 0) ** 2) / 2
        bound[(q_row[part][:, None] == v_row[None, :]) | (bound < least[part][:, None])] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        for row in range(len(bound)):
            ranked = order[row]
            limit = int(np.isfinite(bound[row]).sum())
            ids, scores = np.empty(0, np.int64), np.empty(0)
            done, step = 0, 64
            while done < limit:
                if len(scores) >= k and bound[row, ranked[done]] < scores[-1]:
                    break
                take = ranked[done : min(limit, done + step)]
                ids = np.append(ids, v_id[take])
                scores = np.append(scores, v[take] @ q[at + row])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                done, step = done + len(take), step * 2
            out[0].extend([int(q_row[at + row])] * (len(ids) + 1))
            out[1].extend([*ids.tolist(), None])
            out[2].extend([*scores.astype(np.int64).tolist(), None])
            out[3].extend([0] * len(ids) + [done])
    return out


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of the two are exact in doubles."""
    return not len(a) or not len(b) or int(abs(a).max()) * int(abs(b).max()) * a.shape[1] < EXACT


def best_of_large(q, q_row, v, v_row, v_id, k: int):
    """best_of_block on integers of any size: every score is computed."""
    out: tuple[list, ...] = ([], [], [], [])
    wide = v.astype(object)
    for own, one in zip(q_row.tolist(), q.astype(object)):
        scores = wide @ one
        ranked = sorted((-s, i) for s, i, r in zip(scores.tolist(), v_id.tolist(), v_row.tolist()) if r != own)
        if ranked and max(-ranked[0][0], ranked[-1][0]) >= 2**63:
            raise OverflowError("an inner product is beyond a long")
        for s, i in ranked[:k]:
            for column, x in zip(out, (own, i, -s, 0)):
                column.append(x)
        for column, x in zip(out, (own, None, None, len(ranked))):
            column.append(x)
    return out


def _integers(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    large = F.raise_error(F.lit("a component is 2 ** 54 or more")).cast("long")
    v = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) < 2.0**54, F.floor(F.lit(256.0) * x.cast("double"))).otherwise(large))
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.coalesce(fit, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"))


def top_inner_products(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, and evaluated: how many scores its query took.  is_query: a condition on column id."""
    spark = df.sparkSession
    ints = written(_integers(df, id_col, vector), "vectors")  # which also holds the rows' numbers fast
    sample: dict[int, tuple[list, list]] = {}
    for r in ints.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").collect():
        rows, vs = sample.setdefault(len(r.v), ([], []))
        rows.append(r.row)
        vs.append(r.v)
    known = {n: (np.array(rows), np.array(vs, float)) for n, (rows, vs) in sample.items()}
    sent = Sent(spark, "pivots", {n: (rows, vs, choose_pivots(vs, PIVOTS)) for n, (rows, vs) in known.items()})

    def distances(rows, ids, vs):
        # A length the sample has not seen has one pivot, the origin.
        pivots = {n: x[2] for n, x in sent.made(dict).items()}
        return [rows, ids, vs, [np.sqrt(((np.array(v, float)[None, :] - pivots.get(len(v), np.zeros((1, len(v))))) ** 2).sum(1)) for v in vs]]

    def thresholds(rows, ids, vs, dists):
        out = []
        for row, v in zip(rows, vs):
            near, scores = sent.made(dict).get(len(v)), np.empty(0)
            if near and fits(near[1], np.array([v])):
                scores = (near[1] @ np.array(v, float))[near[0] != row]
            out.append(float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf)
        return [rows, ids, vs, dists, out]

    columns = "row long, id long, v array<long>, dist array<double>"
    pivot_table = written(arrow_map(ints, distances, columns), "pivot-table")
    asked = written(arrow_map(pivot_table.where(is_query), thresholds, columns + ", least double"), "queries")
    v_blocks, q_blocks = (max(1, math.ceil(x.count() / size)) for x, size in ((pivot_table, VECTOR_BLOCK), (asked, QUERY_BLOCK)))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn("length", F.size("v"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(asked, "q_block", q_blocks, "v_block", v_blocks)
    right = dealt(pivot_table, "v_block", v_blocks, "q_block", q_blocks)

    def meet(q, v):
        import pyarrow as pa

        def wide(t, c):
            return np.stack(t.column(c).combine_chunks().to_numpy(zero_copy_only=False))

        found = ([], [], [], [])
        if q.num_rows and v.num_rows:
            flat = [t.column(c).to_numpy() for t, c in ((q, "row"), (q, "least"), (v, "row"), (v, "id"))]
            qs, vs = wide(q, "v"), wide(v, "v")
            if fits(qs, vs):
                found = best_of_block(qs.astype(float), flat[0], wide(q, "dist"), flat[1], vs.astype(float), flat[2], flat[3], wide(v, "dist"), k)
            else:
                found = best_of_large(qs, flat[0], vs, flat[2], flat[3], k)
        id_of = dict(zip(q.column("row").to_pylist(), q.column("id").to_pylist()))
        found = ([id_of[x] for x in found[0]], *found)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "q_row", "vec_id", "score", "evaluated"), found)})

    keys = ("length", "q_block", "v_block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, q_row long, vec_id long, score long, evaluated long")
    # A query has k rows a block, and one that counts, without a vector.
    best = Window.partitionBy("q_row").orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = near.select(
        "query_id", F.row_number().over(best).alias("rank"), "vec_id", "score", F.sum("evaluated").over(Window.partitionBy("q_row")).alias("evaluated")
    )
    return ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull())


def op3_pivot_topk(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0).drop("evaluated")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS q_row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id)::int AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
