"""Operator 9: near duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle throws a hash at one of T bins, and a bin keeps
the least value of the first round that reaches it; after T rounds, round T + b throws all shingles at bin b, so every
coordinate fills.  Bands of ROWS coordinates are bucket keys.  With 45 bands of 5, a pair at the threshold of 0.8 misses
all buckets with a chance of 2e-8.

1. Documents with equal shingle sets form a class; only its least doc_id goes on.
2. Each bucket's least member is its hub.  Pairs of hub and member whose sizes and sketches allow the threshold are
   verified on full sets; components of the verified links give first labels.
3. Buckets that still hold several labels are compared in blocks of at most BLOCK members, sketches against sketches.
   A first round takes from each block only a forest of its likeliest pairs between labels, which after verification
   joins nearly all that belongs together; a second also looks at the sets, by half of each hash, and takes every pair
   of different labels that reaches the threshold so, from the first bucket it shares.  All are verified on full sets.  Members of one component are not compared
   again: in a large bucket of m members, s of them outside its main label, s * m / BLOCK rows are dealt, not m * m.
   A bucket of few but long members counts as large too: a block has BLOCK members and about BLOCK_SHINGLES shingles.
4. Components of all verified links.

A sketch estimate below SLACK is over five standard deviations under the threshold.

Words are runs of anything but ASCII white space, A-Z in lower case.  A text with fewer words than a shingle is one
shingle; null texts and those without words have none and link with nothing.  Rows with words that share a doc_id are
one document.
Null doc_ids link with nothing and stay.  An empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import afresh, arrow_map, by_ids, table, written
from matchloom.llm.graph import components

BANDS, ROWS = 45, 5
T = BANDS * ROWS
#: Least share of equal coordinates; its standard deviation at 0.8 is 0.027.
SLACK = 0.65
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
KEPT_WORDS = 200_000

_U = np.uint64
_RNG = np.random.default_rng(20170419)
_MULT = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = _RNG.integers(1, 2**63, 2 * T, dtype=np.uint64)
_BAND_MULT = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: _WordHash) -> np.ndarray:
    """The sorted set of hashed k-word shingles."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < k:
        return _mix(np.array([(h * _MULT[:n]).sum(dtype=np.uint64) + _U(n)], np.uint64))
    whole = h[: n - k + 1] * _MULT[0]
    for i in range(1, k):
        whole = whole + h[i : n - k + 1 + i] * _MULT[i]
    return np.unique(_mix(whole + _U(k)))


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates; round in the upper half, hash in the lower."""
    out = np.zeros(T, np.uint64)
    empty = np.ones(T, bool)
    at = 0
    while at < T and empty.any():
        # As many rounds at once as will likely fill what is left.
        open_bins = int(empty.sum())
        rounds = min(T - at, max(1, int(T * (np.log(open_bins) + 1) / len(s)) if len(s) else T), max(1, 400_000 // len(s)))
        h = _mix(s[None, :] ^ _SEEDS[at : at + rounds, None])
        low = h & _U(0xFFFFFFFF)
        bins = ((h >> _U(32)) * _U(T)) >> _U(32)
        # Bin, round and hash in one number: 12 + 20 bits and the hash's upper 32.
        key = (bins << _U(44)) | (np.arange(at, at + rounds, dtype=np.uint64)[:, None] << _U(32)) | low
        key = np.sort(key, axis=None)
        b = (key >> _U(44)).astype(np.int64)
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        hit = b[first]
        new = empty[hit]
        out[hit[new]] = key[first[new]] & _U((1 << 44) - 1)
        empty[hit] = False
        at += rounds
    for b in np.flatnonzero(empty):
        h = _mix(s ^ _SEEDS[T + b])
        out[b] = (_U(T + b) << _U(32)) | (h & _U(0xFFFFFFFF)).min()
    return out


def bands(sk: np.ndarray) -> np.ndarray:
    keys = (_mix(sk).reshape(BANDS, ROWS) * _BAND_MULT).sum(1, dtype=np.uint64)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _similar(sa: np.ndarray, sb: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(sa, sb, assume_unique=True).size
    return 100 * common >= percent * (len(sa) + len(sb) - common)


def signatures(df: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    def run(ids, texts):
        import xxhash

        out = []
        for t in texts:
            s = shingles(t, k, hashes)
            if not len(s):
                out.append((0, None, None, None))
                continue
            sk = sketch(s)
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(sk), (_mix(sk) >> _U(48)).astype(np.uint16).tobytes()))
        return [ids, *(list(x) for x in zip(*out))]

    hashes = _WordHash()
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return arrow_map(rows, run, "doc_id long, n long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """doc_id and the shingle set, as bytes, of the documents that needed (column id) names; and the set again by the
    upper 32 bits of its hashes."""

    def run(ids, texts):
        full = [shingles(t, k, hashes) for t in texts]
        return [ids, [s.tobytes() for s in full], [(s >> _U(32)).astype(np.uint32).tobytes() for s in full]]

    hashes = _WordHash()
    return arrow_map(by_ids(docs, "doc_id", needed, "left_semi"), run, "doc_id long, shingles binary, short binary", rows=128)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    one = sketches.select(F.col("rep").alias("a_id"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sk"))
    two = sketches.select(F.col("rep").alias("b_id"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sk"))
    met = pairs.join(two, F.col("b") == F.col("b_id")).join(one, F.col("a") == F.col("a_id"))
    met = met.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))

    def run(a, b, a_sk, b_sk):
        same = [int((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).sum()) >= SLACK * T for x, y in zip(a_sk, b_sk)]
        return [[x for x, s in zip(c, same) if s] for c in (a, b)]

    return arrow_map(met.select("a", "b", "a_sk", "b_sk"), run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs that reach the threshold on their full sets, which are made unless they are at hand."""
    pairs = written(pairs, "pairs")
    if sets is None:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = written(_sets(docs, written(needed, "needed"), k), "sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("b_id"), F.col("shingles").alias("sb")), F.col("b") == F.col("b_id"))
    met = met.join(sets.select(F.col("doc_id").alias("a_id"), F.col("shingles").alias("sa")), F.col("a") == F.col("a_id"))

    def run(a, b, sa, sb):
        ok = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(sa, sb)]
        return [[x for x, s in zip(c, ok) if s] for c in (a, b)]

    return written(arrow_map(met.select("a", "b", "sa", "sb"), run, "a long, b long", rows=128).distinct(), "links")


def _joining(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs of numbers below n, in their order, join what the pairs before have not joined."""
    root, out = list(range(n)), np.zeros(len(a), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(a), 10_000):
        # Pairs that are joined before a stretch begins are passed over together.
        now = np.array([find(x) for x in range(n)])
        for k in (at + np.flatnonzero(now[a[at : at + 10_000]] != now[b[at : at + 10_000]])).tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                root[x], out[k] = y, True
    return out


def _nearly(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs reach the threshold, or miss it by what equal halves of hashes may feign, on sets of half hashes."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    out, here = np.zeros(len(i), bool), np.zeros(int(flat.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = flat[starts[i[part[0]]] : starts[i[part[0]] + 1]]
        here[own] = True
        for at in range(0, len(part), 256):
            some = part[at : at + 256]
            common = np.array([np.count_nonzero(here[flat[starts[x] : starts[x + 1]]]) for x in j[some]])
            out[some] = 100 * (common + 2) >= percent * (sizes[i[some]] + sizes[j[some]] - common - 2)
        here[own] = False
    return out


def _block_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """rows: key, band, one, two (numbers of a block's two sides), side (which of them), rep, label, n, bands, sketch.  Pairs of
    different labels that may reach the threshold: by their sketches, and of those only what joins labels that likelier
    pairs of the block have not joined yet (forest); or by sketches and by column short, all those whose first shared
    band is this one."""
    import pyarrow as pa

    def compare(part):
        band = part.column("band")[0].as_py()
        side = part.column("side").to_numpy()
        rep, label, n = (part.column(c).to_numpy() for c in ("rep", "label", "n"))
        n = np.minimum(n, 2**31 // 200).astype(np.int32)  # longer ones are told apart on their sets
        keys = np.array(part.column("bands").to_pylist(), np.int64)
        sk = np.stack([np.frombuffer(x, np.uint16) for x in part.column("sketch").to_pylist()])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        apart = label[left][:, None] != label[right][None, :]
        small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        apart &= 100 * small >= percent * large
        for j in range(0 if forest else band):
            apart &= keys[left, j][:, None] != keys[right, j][None, :]
        i, j = np.nonzero(apart)
        i, j = left[i].astype(np.int32), right[j].astype(np.int32)
        del apart, small, large
        found = [np.empty(0, np.int64)] * 2
        equal = np.zeros(len(i), np.int16)
        for at in range(0, len(i), 20_000):
            equal[at : at + 20_000] = (sk[i[at : at + 20_000]] == sk[j[at : at + 20_000]]).sum(1)
        keep = equal >= SLACK * T
        if forest and keep.any():
            best = np.flatnonzero(keep)
            best = best[np.argsort(-equal[best], kind="stable")]
            distinct, own = np.unique(label, return_inverse=True)
            keep[best] = _joining(own[i[best]], own[j[best]], len(distinct))
        elif keep.any():
            sets = [np.frombuffer(x, np.uint32) for x in part.column("short").to_pylist()]
            keep[keep] = _nearly(i[keep], j[keep], sets, percent)
        if keep.any():
            a, b = rep[i[keep]], rep[j[keep]]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).T
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return rows.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long")


def _stragglers(members: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, docs: DataFrame | None = None, k: int = 0):
    """Candidate pairs of different labels within buckets, a forest or, given docs, all; and the sets that took."""
    labelled = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "key", "band", "rep", "n", "size", "weight", F.coalesce("component", "rep").alias("label")
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c"))
    mixed = mixed.where((F.col("l0") != F.col("l1")) & (F.col("c") > 2)).select(F.col("key").alias("of"))
    rows = written(labelled.join(mixed, F.col("key") == afresh(F.col("of")), "left_semi"), "mixed")
    sk = sketches.select(F.col("rep").alias("of_rep"), F.col("n").alias("of_n"), "bands", "sketch")
    sets = None
    if docs is not None:
        sets = written(_sets(docs, written(rows.select(F.col("rep").alias("id")).distinct(), "needed"), k), "sets")
        sk = sk.join(sets.select("doc_id", "short"), F.col("of_rep") == F.col("doc_id")).drop("doc_id")
    # Most buckets are one block.  In a larger one, the members of its main label need not meet each other: they are
    # dealt to blocks once, and each block meets all others, who also meet among themselves.
    zero, none = F.lit(0), F.lit(-1)
    small = (F.col("size") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES)
    whole = rows.where(small).select("key", "band", "rep", "n", "label", zero.alias("one"), zero.alias("two"), zero.alias("side"))
    large = rows.where(~small)
    tally = large.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    most = F.max(F.struct("c", "label", "w"))
    main = tally.groupBy(F.col("key").alias("of")).agg(most["label"].alias("main"), most["c"].alias("most"), most["w"].alias("most_w"), F.sum("c").alias("members"), F.sum("w").alias("whole_w"))
    large = large.join(main, F.col("key") == afresh(F.col("of")))

    def blocks(members, shingles):
        return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    def dealt(n):
        return F.pmod(F.xxhash64("rep"), n).cast("int")

    own = ("key", "band", "rep", "n", "label")
    main_blocks, other_blocks = blocks(F.col("most"), F.col("most_w")), blocks(F.col("members") - F.col("most"), F.col("whole_w") - F.col("most_w"))
    mains = large.where("label = main").select(*own, dealt(main_blocks).alias("one"), none.alias("two"), zero.alias("side"))
    others = large.where("label <> main")
    across = others.select(*own, F.explode(F.sequence(zero, main_blocks - 1)).alias("one"), none.alias("two"), F.lit(1).alias("side"))
    among = others.select(*own, dealt(other_blocks).alias("block"), F.explode(F.sequence(zero, other_blocks - 1)).alias("other"))
    among = among.select(
        *own, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    rows = whole.unionAll(mains).unionAll(across).unionAll(among)
    rows = rows.join(sk, (F.col("rep") == F.col("of_rep")) & (F.col("n") == F.col("of_n"))).drop("of_rep", "of_n")
    return _block_pairs(rows, percent, docs is None).distinct(), sets


def near_components(df: DataFrame, k: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df."""
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(docs, k, "doc_id", "text"), "signatures")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Written, so that joins with it deal both sides anew and Spark can split a digest that many rows have.
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    owned = full.join(classes.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    # Rows of one doc_id keep a sketch for each of their texts.
    sketches = owned.where("doc_id = rep").select("rep", "n", "bands", "sketch", "digest")
    sketches = written(sketches.dropDuplicates(["rep", "digest"]).drop("digest"), "sketches")

    # Rows of one doc_id may be of several classes.
    torn = owned.groupBy(F.col("doc_id").alias("id")).agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
    same = owned.select("doc_id", "rep").join(torn, F.col("doc_id") == F.col("id")).where("rep <> a")
    same = written(same.select("a", F.col("rep").alias("b")).distinct(), "same")

    rows = sketches.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("rep").alias("hub")).where("size > 1")
    members = rows.join(buckets, F.col("key") == afresh(F.col("of"))).select("key", "band", "rep", "n", "hub", "size", "weight")
    members = written(members, "members")

    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = _verified(docs, _likely(stars, sketches, percent), k, percent)
    found = written(components(first.unionAll(same)), "labels")
    for last in (False, True):
        pairs, sets = _stragglers(members, found, sketches, percent, docs if last else None, k)
        more = _verified(docs, pairs, k, percent, sets)
        links = found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(more)
        found = written(components(links), "labels")

    of = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "rep").alias("least"))
    out = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(of, F.col("digest") == F.col("of"), "left")
    component = F.coalesce("least", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op9_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=4)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles: that with the least doc_id."""
    gone = near_components(docs, k=5).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return by_ids(docs, "doc_id", written(gone, "gone"), "left_anti")


#: All pairs that share a shingle, counted: exact, and affordable on small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(c.least, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""
