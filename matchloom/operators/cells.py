"""Exact dense search over vectors in cells.

CELLS centres are chosen far apart among at most SAMPLE vectors; they alone are known to the driver.  Every vector lies
in the cell of its nearest centre, a cell's radius is that of its farthest vector.  A query's product with a vector of a
cell is at most its product with the centre plus its length times the radius.  Queries first meet the cell of highest
bound, which gives each a k-th score, and then only the cells whose bound reaches that: no vector that could be among
the k best is left out.  Queries and cells meet in blocks of bounded size, dealt by hashes, in Spark's tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.shared import stored

CELLS, SAMPLE = 64, 4096
#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
DIGITS = 6
#: What rounding may do to a product stays far below this.
EASE = 1e-5


def choose_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal, from the vector nearest to the mean; none twice."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmin())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _flat(column, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def in_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """ord, v, cell and away, the distance to the cell's centre."""
    import pyarrow as pa

    sent, size = docs.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    def run(batches):
        for batch in batches:
            v = _flat(pa.Table.from_batches([batch]).column("v"), size)
            away = np.stack([((v - c) ** 2).sum(1) for c in sent.value], 1)
            cell = away.argmin(1)
            far = np.sqrt(away[np.arange(len(v)), cell])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=["ord", "v", "cell", "away"])

    return docs.mapInArrow(run, "ord long, v array<float>, cell int, away double")


def _bounds(queries: DataFrame, centres: np.ndarray, radii: dict[int, float]) -> DataFrame:
    """query_id, q, and bounds, an array of cell and bound, the highest first."""
    import pyarrow as pa

    sent = queries.sparkSession.sparkContext.broadcast((centres, sorted(radii.items())))
    schema = "query_id long, q array<float>, cells array<int>, bounds array<double>"

    def run(batches):
        centres, known = sent.value
        cells, radius = np.array([c for c, _ in known], np.int64), np.array([r for _, r in known], float)
        for batch in batches:
            q = _flat(pa.Table.from_batches([batch]).column("q"), centres.shape[1])
            bound = q @ centres[cells].T + np.sqrt((q**2).sum(1))[:, None] * radius
            order = np.argsort(-bound, axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells[order].tolist(), pa.list_(pa.int32())), pa.array(np.take_along_axis(bound, order, 1).tolist(), pa.list_(pa.float64()))],
                names=["query_id", "q", "cells", "bounds"],
            )

    return queries.mapInArrow(run, schema)


def _met(asked: DataFrame, held: DataFrame, sizes: DataFrame, k: int, size: int) -> DataFrame:
    """query_id, ord, score of each block's k best of a query, and of how many vectors (ord null, in score).  asked: query_id,
    q, cell; held: ord, v, cell; sizes: cell, parts, broadcast."""
    import pyarrow as pa

    def deal(n):
        return lambda c: F.pmod(F.xxhash64(c), n).cast("int")

    count = asked.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_parts"))
    told = F.broadcast(count.join(sizes, F.col("of") == F.col("sized")).select("of", "q_parts", "parts"))  # a row a cell
    zero = F.lit(0)
    left = asked.join(told, F.col("cell") == F.col("of")).withColumn("q_part", deal(F.col("q_parts"))("query_id")).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    right = held.join(told, F.col("cell") == F.col("of")).withColumn("part", deal(F.col("parts"))("ord")).withColumn("q_part", F.explode(F.sequence(zero, F.col("q_parts") - 1)))
    keys = ("cell", "q_part", "part")

    def compare(q, v):
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        seen = [np.empty(0, np.int64), np.empty(0)]
        if q.num_rows and v.num_rows:
            ids, ords = q.column("query_id").to_numpy(), v.column("ord").to_numpy()
            scores = np.round(_flat(q.column("q"), size) @ _flat(v.column("v"), size).T, DIGITS)
            order = np.lexsort((np.broadcast_to(ords, scores.shape), -scores), axis=1)[:, :k]
            found = [np.repeat(ids, order.shape[1]), ords[order].ravel(), np.take_along_axis(scores, order, 1).ravel()]
            seen = [ids, np.full(len(ids), float(len(ords)))]
        return pa.table({
            "query_id": np.concatenate([found[0], seen[0]]), "score": np.concatenate([found[2], seen[1]]),
            "ord": pa.array(np.concatenate([found[1], np.zeros(len(seen[0]), np.int64)]), pa.int64(), mask=np.arange(len(found[1]) + len(seen[0])) >= len(found[1])),
        }).select(["query_id", "ord", "score"])

    left, right = left.select(*keys, "query_id", "q"), right.select(*keys, "ord", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, ord long, score double")


def search(queries: DataFrame, docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """query_id, ord and score, among them every query's k best; and query_id and compared, how many vectors each met.
    queries: query_id and q; docs: ord and v.  Rows without a vector, or with one of another length than the first, take
    no part."""
    spark = queries.sparkSession
    nothing = spark.createDataFrame([], "query_id long, ord long, score double"), spark.createDataFrame([], "query_id long, compared long")
    docs = docs.where("v IS NOT NULL").select(F.col("ord").cast("long").alias("ord"), F.col("v").cast("array<float>").alias("v"))
    sample = docs.orderBy(F.xxhash64("ord")).limit(SAMPLE).select("v").collect()
    if not sample:
        return nothing
    size = len(sample[0].v)
    centres = choose_centres(np.array([r.v for r in sample if len(r.v) == size], float), CELLS)
    held = stored(in_cells(docs.where(F.size("v") == size), centres), "cells")
    told = held.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
    asked = queries.where("q IS NOT NULL").where(F.size("q") == size).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<float>").alias("q"))
    asked = stored(_bounds(asked, centres, {r.cell: r.radius for r in told}), "bounds")
    sizes = spark.createDataFrame([(r.cell, -(-r.n // VECTOR_BLOCK)) for r in told], "sized int, parts int")
    first = stored(_met(asked.select("query_id", "q", F.get("cells", F.lit(0)).alias("cell")), held, sizes, k, size), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = first.where("ord IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    least = stored(least.select(F.col("query_id").alias("of"), F.col("score").alias("least")), "least")
    near = asked.join(least, F.col("query_id") == F.col("of"), "left").select("query_id", "q", "least", F.explode(F.slice(F.arrays_zip("cells", "bounds"), 2, CELLS)).alias("c"))
    near = stored(near.where(F.col("least").isNull() | (F.col("c.bounds") + EASE >= F.col("least"))).select("query_id", "q", F.col("c.cells").alias("cell")), "near")
    every = stored(first.unionAll(_met(near, held, sizes, k, size)), "dense")
    compared = every.where("ord IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("compared"))
    return every.where("ord IS NOT NULL"), compared
