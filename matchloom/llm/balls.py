"""Operator 13: centroid clustering by ball-tree filtering.

Vectors become integers, floor(64 x).  Each task builds metric trees over what it has, TREE vectors a tree: a node is a
ball with its centre, radius, count and exact integer sum; it is cut in two by the vectors nearer to one or the other
of two far members, down to leaves of LEAF vectors.  The trees are written once.  In a round the sixteen centroids, a
fixed number of fixed length, are sent to all tasks and go down each tree level by level.  A centroid whose distance
to a ball's centre exceeds the nearest one's by more than twice the radius can be nearest to none of its vectors and
is dropped there; a ball with one centroid left is assigned whole, by its count and sum; a leaf with several compares
its vectors exactly.  Bounds are eased by more than rounding errs, so the assignment is that of comparing all with all,
ties at the smaller number included.  Each task sends one count and one sum a cluster, Spark adds them up, and a
non-empty centroid moves to floor(sum / count) by component.

Rows take part with exactly `dims` components, none null or non-finite; all others, null vectors among them, have no
row in the result.  Repeated rows, and rows that share an id or have none, count each for itself; at the start ties of
hashes go by the vector, and a null id hashes like the empty one.  With fewer rows than clusters there are as many
centroids as rows; an empty table gives an empty result.  Components of 2 ** 27 or more as integers raise an error:
below, squared distances fit a long.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, table, written

TREE, LEAF = 4096, 32
MOST = 2**27


def ball_tree(v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the vectors in the tree, and its nodes, parents first: start and stop in that order, the number of
    the first of two children or -1, centre, radius and sum."""
    order = np.arange(len(v))
    spans, first, whole = [(0, len(v))], [-1], v.astype(float)
    at = 0
    while at < len(spans):
        start, stop = spans[at]
        own = order[start:stop]
        if stop - start > LEAF:
            part = whole[own]
            a = part[((part - part[0]) ** 2).sum(1).argmax()]
            b = part[((part - a) ** 2).sum(1).argmax()]
            near = (part @ (b - a)) < ((b * b).sum() - (a * a).sum()) / 2
            n = int(near.sum())
            if 0 < n < len(own):  # vectors that are all equal stay one leaf
                order[start:stop] = np.concatenate([own[near], own[~near]])
                first[at] = len(spans)
                spans += [(start, start + n), (start + n, stop)]
                first += [-1, -1]
        at += 1
    starts, stops = np.array(spans, np.int64).T
    before = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(v[order], 0)])
    sums = before[stops] - before[starts]
    centres = sums / (stops - starts)[:, None]
    radii = np.array([np.sqrt(((whole[order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centres)])
    return order, {"start": starts, "stop": stops, "first": np.array(first, np.int64), "centre": centres, "radius": radii, "sum": sums}


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(v), len(c)), np.int64)
    for i, one in enumerate(c):
        apart = v - one
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def assigned(v: np.ndarray, nodes: dict[str, np.ndarray], c: np.ndarray):
    """v: the vectors in the order of their tree.  The cluster of each; count and sum of each cluster; and of how many
    vectors the distances were computed."""
    cluster = np.full(len(v), -1, np.int64)
    counts, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    front, open_to = np.zeros(min(len(v), 1), np.int64), np.ones((min(len(v), 1), len(c)), bool)
    whole, compared = c.astype(float), 0
    while len(front):
        centre, radius = nodes["centre"][front], nodes["radius"][front]
        apart = np.sqrt(np.maximum(((centre[:, None, :] - whole[None]) ** 2).sum(2), 0))
        apart[~open_to] = np.inf
        ease = 1e-9 * (apart.min(1) + radius) + 1e-6
        open_to &= apart <= (apart.min(1) + 2 * radius + ease)[:, None]
        alone = open_to.sum(1) == 1
        for node, i in zip(front[alone], open_to[alone].argmax(1)):
            start, stop = nodes["start"][node], nodes["stop"][node]
            cluster[start:stop] = i
            counts[i] += stop - start
            sums[i] += nodes["sum"][node]
        leaf = ~alone & (nodes["first"][front] < 0)
        for node, left in zip(front[leaf], open_to[leaf]):
            start, stop = nodes["start"][node], nodes["stop"][node]
            among = np.flatnonzero(left)
            own = among[squared(v[start:stop], c[among]).argmin(1)]
            cluster[start:stop] = own
            compared += int(stop - start)
            counts += np.bincount(own, minlength=len(c))
            np.add.at(sums, own, v[start:stop])
        down = ~alone & ~leaf
        children = nodes["first"][front[down]]
        front = np.concatenate([children, children + 1])
        open_to = np.concatenate([open_to[down], open_to[down]])
    return cluster, counts, sums, compared


NODES = (("start", np.int64), ("stop", np.int64), ("first", np.int64), ("centre", np.float64), ("radius", np.float64), ("sum", np.int64))
FOREST = "ids array<long>, vectors binary, " + ", ".join(f"`{n}` binary" for n, _ in NODES)


def grown(rows: DataFrame, dims: int) -> DataFrame:
    """One row a tree: the ids of its vectors, the vectors in that order, and the nodes.  rows: id, v."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(FOREST))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                ids, v = part.column(0).to_pylist(), part.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                order, nodes = ball_tree(v)
                row = [[ids[i] for i in order.tolist()], v[order].tobytes(), *(nodes[n].astype(kind).tobytes() for n, kind in NODES)]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, target)], schema=target)

    return rows.mapInArrow(run, FOREST)


def _read(row: dict, dims: int):
    v = np.frombuffer(row["vectors"], np.int64).reshape(-1, dims)
    nodes = {n: np.frombuffer(row[n], kind) for n, kind in NODES}
    for n in ("centre", "sum"):
        nodes[n] = nodes[n].reshape(-1, dims)
    return v, nodes


def totals(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, count, sums and compared: one row a cluster."""
    import pyarrow as pa

    sent, dims = Sent(forest.sparkSession, "centroids", centroids.tolist()), centroids.shape[1]

    def run(batches):
        c = np.array(sent.made(list), np.int64)
        counts, sums, compared = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                _, n, s, some = assigned(*_read(row, dims), c)
                counts, sums, compared = counts + n, sums + s, compared + some
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(met, pa.int32()), "n": pa.array(counts[met], pa.int64()), "s": pa.array(sums[met].tolist(), pa.list_(pa.int64())),
            "compared": pa.array([compared] * (len(met) > 0) + [0] * max(len(met) - 1, 0), pa.int64()),
        })

    parts = forest.drop("ids").mapInArrow(run, "cluster int, n long, s array<long>, compared long")
    added = (F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *added)


def moved(forest: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and of how many vectors the distances were computed."""
    out, compared = centroids.copy(), 0
    for r in totals(forest, centroids).collect():  # a row a cluster
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(centroids.shape[1])]
        compared += r.compared
    return out, compared


def _integers(df: DataFrame, dims: int, scale: int, id_col: str, vector: str) -> DataFrame:
    x, limit = F.col(f"`{vector}`"), float(MOST)
    fit = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.coalesce(fit, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double")).alias("v"))
    large = F.raise_error(F.lit("a component is 2 ** 27 or more")).cast("long")
    return rows.select("id", F.transform("v", lambda c: F.when(F.abs(c) < limit, F.floor(c)).otherwise(large)).alias("v"))


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid, an array, of every vector that takes part."""
    import pyarrow as pa

    rows = _integers(df, dims, scale, id_col, vector)
    forest = written(grown(rows, dims), "forest")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r.v for r in rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    centroids = np.array(start, np.int64).reshape(-1, dims)
    for _ in range(rounds):
        centroids, _ = moved(forest, centroids)
    sent = Sent(df.sparkSession, "centroids", centroids.tolist())

    def run(batches):
        c = np.array(sent.made(list), np.int64).reshape(-1, dims)
        for batch in batches:
            for row in batch.to_pylist():
                v, nodes = _read(row, dims)
                cluster = assigned(v, nodes, c)[0]
                apart = v - c[cluster]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(np.einsum("ij,ij->i", apart, apart), pa.int64()),
                })

    out = written(forest.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    own = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = {r.cluster: r.cluster_inertia for r in own.collect()}  # a row a cluster
    of = df.sparkSession.createDataFrame(
        [(i, own.get(i, 0), sum(own.values()), c) for i, c in enumerate(centroids.tolist())],
        "of int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return out.join(F.broadcast(of), F.col("cluster") == F.col("of")).drop("of")


def op13_ball_tree_clusters(spark, sf_dir: str) -> DataFrame:
    out = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _round(n: int) -> str:
    """CTEs a{n}: row, cluster, d, of every vector; and, but for the last, c{n + 1}."""
    return f"""
a{n} AS (
  SELECT row, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS d FROM (
    SELECT row, cluster, list_sum(list_transform(list_zip(v.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint AS d FROM v, c{n}
  ) GROUP BY row
)"""


def _next(n: int) -> str:
    return f"""
s{n} AS (
  SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a{n}.cluster, v.v, unnest(range(1, 65)) AS i FROM a{n} JOIN v USING (row)) GROUP BY cluster, i
), m{n} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS v FROM s{n} GROUP BY cluster
), c{n + 1} AS (
  SELECT c{n}.cluster, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (cluster)
)"""


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 AS cluster, v FROM v
  ORDER BY cluster LIMIT 16
), {','.join(_round(n) + ',' + _next(n) for n in range(3))}, {_round(3)}
SELECT vec_id, a3.cluster::int AS cluster, d AS distance, sum(d) OVER (PARTITION BY a3.cluster)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN v USING (row) JOIN c3 ON a3.cluster = c3.cluster
"""
