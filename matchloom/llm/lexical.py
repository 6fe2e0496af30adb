"""Operator 11: ranked lexical search by hierarchical max trees over document ranges.

Documents are counted once: their length in terms, and how often they hold each term that some item asks for.  From
that come N, L and the terms' weights.  Then every task takes its documents in shards.  In a shard each term has a tree
over document ranges of FAN, FAN * FAN, ... documents; a node holds the greatest share that the term gives to a score
there.  An item's bound on a range is the weighted sum over its terms.  The search opens the ranges of highest bound
first, down to single documents, whose bounds are their scores, and ends when the highest bound left is below the k-th
score so far; ranges that equal it are opened, since they may hold a smaller doc_id.  The k-th score runs on over the
shards of a task, and starts at what holds for all: the item's k-th best score among about SAMPLE documents.  Only each
task's k best of an item leave it; all of them are ranked at the end.  Everything but the weights is integer, so the
result is that of scoring every document.

Items go to all tasks in blocks of about BLOCK_PAIRS pairs of item and term.  The asked terms are sent along to the
counting while they are at most VOCABULARY, counted first, of VOCABULARY_BYTES; beyond, counts are joined with them.

A null text has no terms: such documents are not ranked and not counted in N; such items find nothing.  Every row is a
document, and every row of the items an item, of its own: repeated rows, equal texts and shared ids each have their
places and rankings.  Equal scores go by doc_id, nulls last.  Without documents or items the result is empty.  Texts
are counted whole, however long.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, arrow_map, table, trimmed, written

FAN = 16
#: Documents and postings of one shard.
SHARD, POSTINGS = FAN**4, 2_000_000
SAMPLE = 16_384
BLOCK_PAIRS = 1_000_000
VOCABULARY, VOCABULARY_BYTES = 500_000, 32_000_000
#: Ranges that are opened at once.
AT_ONCE = 8

#: Letters and digits of ASCII, A-Z in lower case, and all that is not ASCII make terms.
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEPT).split()


class Trees:
    """The max trees of a shard.  keys[l]: sorted term * ranges[l] + range; most[l]: the greatest share there.  At level 0 a
    range is a document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, share: np.ndarray, docs: int):
        height = 1
        while FAN**height < docs:
            height += 1
        self.ranges = [FAN ** (height - level) for level in range(height + 1)]
        key = term * self.ranges[0] + doc
        order = np.argsort(key, kind="stable")
        self.keys, self.most = [key[order]], [share[order]]
        for _ in range(height):
            up = self.keys[-1] // FAN
            first = np.flatnonzero(np.append(True, up[1:] != up[:-1])) if len(up) else np.empty(0, np.int64)
            self.keys.append(up[first])
            self.most.append(np.maximum.reduceat(self.most[-1], first) if len(up) else self.most[-1])

    def below(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bounds of the FAN ranges below each node, for an item's terms."""
        keys, most = self.keys[level - 1], self.most[level - 1]
        low = (terms[:, None] * self.ranges[level - 1] + FAN * nodes[None, :]).ravel()
        start, stop = np.searchsorted(keys, low), np.searchsorted(keys, low + FAN)
        size = stop - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(low)), size)
        out = np.zeros(len(nodes) * FAN, np.int64)
        np.add.at(out, which % len(nodes) * FAN + keys[at] % FAN, weights[which // len(nodes)] * most[at])
        return out.reshape(len(nodes), FAN)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int):
        """The documents that can be among the k best, and their scores, none below least; and the ranges opened."""
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        height = len(self.ranges) - 1
        heap, opened = [(-np.iinfo(np.int64).max, height, 0)], 0
        while heap and -heap[0][0] >= least:
            some = [heapq.heappop(heap)]
            # The next best, and all whose bound is the same.
            while heap and -heap[0][0] >= least and (len(some) < AT_ONCE or heap[0][0] == some[-1][0]):
                some.append(heapq.heappop(heap))
            opened += len(some)
            for level in {x[1] for x in some}:
                nodes = np.array([x[2] for x in some if x[1] == level], np.int64)
                bounds = self.below(level, nodes, terms, weights)
                row, child = np.nonzero(bounds >= max(least, 1))
                bound, child = bounds[row, child], nodes[row] * FAN + child
                if level > 1:
                    for x in zip((-bound).tolist(), [level - 1] * len(bound), child.tolist()):
                        heapq.heappush(heap, x)
                    continue
                docs, scores = np.append(docs, child), np.append(scores, bound)
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
                    docs, scores = docs[scores >= least], scores[scores >= least]
        return docs, scores, opened


def counted(docs: DataFrame, vocabulary: DataFrame, doc: str, text: str) -> DataFrame:
    """row, doc_id, n (terms with repeats), ids and tfs of every document.  vocabulary: term, id, a written table."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    few = n <= VOCABULARY and size <= VOCABULARY_BYTES
    sent = Sent(docs.sparkSession, "terms", {r.term.encode(): r.id for r in vocabulary.collect()} if few else None)

    def run(row, doc_id, texts):
        from collections import Counter

        asked = sent.made(lambda x: x)
        lengths, ids, tfs = [], [], []
        for t in texts:
            words = terms_of(t.encode() if t else None)
            tf = Counter(words)
            lengths.append(len(words))
            held = list(tf if asked is None else tf.keys() & asked.keys())
            ids.append([w.decode() for w in held] if asked is None else [asked[w] for w in held])
            tfs.append([tf[w] for w in held])
        return [row, doc_id, lengths, ids, tfs]

    kind = "int" if few else "string"
    out = arrow_map(rows, run, f"row long, doc_id long, n long, ids array<{kind}>, tfs array<long>", rows=256)
    if few:
        return written(out, "counted")
    out = written(out, "counted-all")
    each = out.select("row", F.explode(F.arrays_zip(F.col("ids").alias("term"), F.col("tfs").alias("tf"))).alias("t")).select("row", "t.term", "t.tf")
    held = each.join(vocabulary, "term").groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("held"))
    none = F.array().cast("array<struct<id: int, tf: long>>")
    out = out.drop("ids", "tfs").join(held, F.col("row") == F.col("of"), "left").withColumn("held", F.coalesce("held", none))
    return written(out.select("row", "doc_id", "n", F.col("held.id").alias("ids"), F.col("held.tf").alias("tfs")), "counted")


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What a term of weight 1 gives to the score of a document of n terms that holds it tf times."""
    if len(n) and 50 * int(n.max()) * n_docs >= 2**63:
        m = np.array([50 + 50 * x * n_docs // length for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * n_docs // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def searched(docs: DataFrame, items: dict, weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """item, doc_id and score of each task's k best documents of every item, and opened, the ranges it took (in a row
    without a score).  items: number -> (term ids, least score)."""
    import pyarrow as pa

    sent = Sent(docs.sparkSession, "items", (items, weights))
    columns = {"item": pa.int64(), "doc_id": pa.int64(), "score": pa.int64(), "opened": pa.int64()}

    def shards(batches):
        """Parts of the documents: ids, lengths and, for each posting, document, term and tf."""
        held, docs_held, postings = [], 0, 0
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                ends = np.cumsum(sizes[at:])
                take = max(1, min(SHARD - docs_held, int(np.searchsorted(ends, POSTINGS - postings, "right"))))
                held.append(batch.slice(at, take))
                docs_held, postings, at = docs_held + held[-1].num_rows, postings + int(ends[len(held[-1]) - 1]), at + take
                if docs_held >= SHARD or postings >= POSTINGS or at < batch.num_rows:
                    yield held
                    held, docs_held, postings = [], 0, 0
        if held:
            yield held

    def run(batches):
        asked, weight = sent.made(lambda x: x)
        asked = {i: (np.array(terms, np.int64), weight[np.array(terms, np.int64)], least) for i, (terms, least) in asked.items()}
        best, opened = {}, 0
        for part in shards(batches):
            whole = pa.Table.from_batches(part).combine_chunks()
            size = np.concatenate([x.column(3).value_lengths().to_numpy() for x in part]).astype(np.int64)
            term, tf = (np.concatenate([x.column(c).flatten().to_numpy() for x in part]).astype(np.int64) for c in (3, 4))
            # Null ids come last: the flag sorts before the id.
            doc_id, nameless = whole.column("doc_id").fill_null(0).to_numpy(), whole.column("doc_id").is_null().to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            trees = Trees(term, doc, shares(tf, whole.column("n").to_numpy()[doc], n_docs, length), len(size))
            for i, (terms, w, least) in asked.items():
                ids, flags, scores = best.get(i, (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)))
                floor = max(least, int(scores[k - 1])) if len(scores) >= k else least
                found, score, n = trees.best(terms, w, k, floor)
                opened += n
                if len(found):
                    ids, flags, scores = np.append(ids, doc_id[found]), np.append(flags, nameless[found]), np.append(scores, score)
                    order = np.lexsort((ids, flags, -scores))[:k]
                    best[i] = (ids[order], flags[order], scores[order])
        rows = [(i, None if no else d, s, None) for i, (ids, flags, scores) in best.items() for d, no, s in zip(ids.tolist(), flags.tolist(), scores.tolist())]
        rows.append((None, None, None, opened))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))
        trimmed()

    return docs.select("row", "doc_id", "n", "ids", "tfs").mapInArrow(run, "item long, doc_id long, score long, opened long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.where("score IS NOT NULL").select("item", F.row_number().over(order).alias("rank"), "doc_id", "score")
    return ranked.where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """item_id, rank, doc_id and score; and what the tasks of each block opened, for reports: column opened."""
    spark = docs.sparkSession

    def own_terms(row, ids, texts):
        return [row, ids, [sorted({w.decode() for w in terms_of(t.encode() if t else None)}) for t in texts]]

    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string"))
    asked = written(arrow_map(asked, own_terms, "item long, item_id long, terms array<string>"), "items")
    pairs = asked.select("item", F.explode("terms").alias("term"))
    # Numbers without gaps: places within partitions, and what comes before a partition.
    numbered = written(pairs.select("term").distinct().withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    sizes = {r.p: r.n for r in numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    begin = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)), F.shiftright("at", 33)) if starts else F.lit(0)
    vocabulary = written(numbered.select("term", (place + begin).cast("int").alias("id")), "terms")
    corpus = counted(docs, vocabulary, doc, text)
    rows, n_docs, length = corpus.agg(F.count("*"), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = corpus.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weighed = written(vocabulary.join(df.select("id", w.alias("w")), "id").select("term", "id", "w"), "weights")
    pairs = written(pairs.join(weighed, "term").where("w > 0").select("item", "id", "w"), "pairs")
    blocks = max(1, math.ceil(pairs.count() / BLOCK_PAIRS))
    sample = corpus.where(F.pmod(F.xxhash64("row"), F.lit(math.ceil(rows / SAMPLE))) == 0) if rows > SAMPLE else None
    found, opened = None, []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("id").alias("ids"), F.collect_list("w").alias("ws"))
        own = own.collect()  # about BLOCK_PAIRS
        weights = np.zeros(1 + max((i for r in own for i in r.ids), default=0), np.int64)
        for r in own:
            weights[r.ids] = r.ws
        asked_terms = {r.item: (list(r.ids), 1) for r in own}
        if sample is not None and own:
            first = _ranked(searched(sample, asked_terms, weights, n_docs, length, k), k)
            for r in first.where(F.col("rank") == k).collect():  # a row an item of the block
                asked_terms[r.item] = (asked_terms[r.item][0], r.score)
        part = written(searched(corpus, asked_terms, weights, n_docs, length, k), "found")
        opened.append(part.select(F.lit(block).alias("block"), "opened").where("opened IS NOT NULL"))
        found = part if found is None else found.unionAll(part)
    out = _ranked(found, k).join(asked.select(F.col("item").alias("of"), "item_id"), F.col("item") == F.col("of"))
    tally = opened[0]
    for x in opened[1:]:
        tally = tally.unionAll(x)
    return out.select("item_id", "rank", "doc_id", "score"), tally


def op11_max_tree_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))[0]


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS t FROM benchmark
), st AS (
  SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::bigint AS l FROM d
), q AS (
  SELECT item, unnest(t) AS term FROM i
), p AS (
  SELECT row, doc_id, len, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS len, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, st GROUP BY term
), x AS (
  SELECT row, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * n) // l))) AS part FROM p JOIN w ON p.term = w.term, st
), s AS (
  SELECT item, row, any_value(doc_id) AS doc_id, sum(part)::bigint AS score FROM q JOIN x ON q.term = x.term GROUP BY item, row
), r AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::int AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r JOIN i ON r.item = i.item WHERE rank <= 50
"""
