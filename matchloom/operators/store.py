"""A stored inverted index: built once, added to and deleted from, opened by many queries, searched by block bounds.

An index is a folder of segments and commits.  A segment holds the documents (ord, dl, range) of one build or append and
their postings in blocks: one row a term and range, the documents of the range that hold the term, with their tf and
dl, and the block's greatest tf and least dl.  A range is RANGE documents that were read together.  Blocks lie in folders by
a hash of the term, sorted by term, so a query reads the folders of its terms alone.  Deletions are rows (segment, ord);
nothing is rewritten until compact().  A commit is one small file that names the live segments and deletions with their
counts and lengths, written last and never over another: a write that breaks off, or a second writer, leaves the index as
it was, and number of documents, mean length and df follow from what is named.

A search bounds each query's score in each range by the blocks' greatest tf and least dl.  A block's bound holds whatever
the mean length has become, since a weight grows with tf and falls with dl.  Ranges are scored in rounds by falling bound:
after each round a query's k-th score so far rules out all ranges whose bound is below it, ties not.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.index import bm25_idf, bm25_weight, joinable, term_counts
from matchloom.operators.rank import DIGITS, padded, top
from matchloom.sources.shared import own_tables, remove, stored

#: Documents of a range; folders by term, and parts of a folder that are written apart, by range.
RANGE, FOLDERS, PARTS = 128, 32, 8
#: Ranges a query scores in the first rounds; all others whose bound allows it come in the last.
ROUNDS = (8, 64)

DOCUMENTS = "ord long, dl long, range long"
BLOCKS = "term string, range long, held array<struct<ord: long, tf: long, dl: long>>, n long, most_tf long, least_dl long, folder int"
DELETED = "segment int, ord long, dl long"


def _blocks_where_they_lie(docs: DataFrame) -> DataFrame:
    """term, range, held, n, most_tf and least_dl of docs' blocks; one row a range, of no term, holds all its documents.
    A range is of one task, so that nothing is shuffled to make its blocks.  docs: ord and tokens."""
    import numpy as np
    import pyarrow as pa

    size, long = RANGE, pa.int64()
    names = ["term", "range", "held", "n", "most_tf", "least_dl"]

    def blocks(rows):
        rows = rows.sort_by("ord").combine_chunks()
        tokens, ords = rows.column("tokens").combine_chunks(), rows.column("ord").combine_chunks()
        dl = np.nan_to_num(tokens.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        doc, values = np.repeat(np.arange(len(ords)), dl), tokens.flatten()
        known = values.is_valid().to_numpy(zero_copy_only=False)
        words = values.filter(pa.array(known)).dictionary_encode()
        keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ords) + doc[known], return_counts=True)
        word, doc = np.divmod(keys, len(ords))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        n = np.diff(starts, append=len(word))
        most = np.maximum.reduceat(tf, starts) if len(starts) else n
        least = np.minimum.reduceat(dl[doc], starts) if len(starts) else n
        # The range's documents come first, under no term.
        counts = [pa.array(np.concatenate(x), long) for x in ([np.zeros_like(dl), tf], [dl, dl[doc]])]
        held = pa.StructArray.from_arrays([pa.concat_arrays([ords, ords.take(pa.array(doc))]), *counts], names=["ord", "tf", "dl"])
        at = np.concatenate([[0], len(ords) + starts, [len(ords) + len(word)]]).astype(np.int32)
        terms = pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(word[starts])).cast(pa.string())])
        count = len(starts) + 1
        told = [pa.array(np.concatenate([[of_all], x]), long) for of_all, x in ((len(ords), n), (0, most), (dl.min(), least))]
        first = pa.array(np.full(count, rows.column("row")[0].as_py() // size if count else 0), long)
        return pa.RecordBatch.from_arrays([terms, first, pa.ListArray.from_arrays(pa.array(at), held), *told], names=names)

    def run(batches):
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            whole = len(rows) // size * size
            for at in range(0, whole, size):
                yield blocks(rows.slice(at, size))
            left = rows.slice(whole)
        if left is not None and len(left):
            yield blocks(left)

    rows = docs.select(F.col("ord").cast("long").alias("ord"), F.col("tokens").cast("array<string>").alias("tokens"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, BLOCKS.removesuffix(", folder int"))


class Index:
    """The index in a folder that Spark can write, as its last commit has it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        names = [n for n in self._listed("commits") if n.isdigit()]
        self.version = max(map(int, names), default=-1)
        if self.version < 0:
            self.segments, self.deletions = [], []
        else:
            text = spark.read.option("wholetext", True).text(f"{self.path}/commits/{self.version}").first().value
            told = json.loads(text)
            self.segments, self.deletions = told["segments"], told["deletions"]

    # The folder.

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        at, fs = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _commit(self, segments: list, deletions: list) -> None:
        at, fs = self._fs(f"commits/{self.version + 1}")
        out = fs.create(at, False)  # fails where another writer was first
        out.write(bytearray(json.dumps({"segments": segments, "deletions": deletions}).encode()))
        out.close()
        self.version, self.segments, self.deletions = self.version + 1, segments, deletions

    def _next(self) -> int:
        """A number that no segment or deletion, committed or not, has."""
        return 1 + max((int(n) for kind in ("segments", "deletions") for n in self._listed(kind) if n.isdigit()), default=-1)

    # Writing.

    def append(self, docs: DataFrame) -> None:
        """docs: ord and tokens; null tokens are none.  An ord that the index has must be deleted first."""
        number = self._next()
        at = f"{self.path}/segments/{number}"
        # Numbers of rows change with the plan that makes them, so documents and blocks are both taken from what is written.
        made = stored(_blocks_where_they_lie(docs), "append")
        rows = made.where("term IS NULL").select("range", F.explode("held").alias("h")).select("h.ord", "h.dl", "range")
        if self.segments and rows.select("ord").join(self.documents().select("ord"), "ord", "left_semi").limit(1).count():
            raise ValueError("the index has a document of this ord already")
        rows.write.parquet(f"{at}/documents")
        blocks = made.where("term IS NOT NULL").withColumn("folder", F.pmod(F.hash("term"), F.lit(FOLDERS))).withColumn("part", F.pmod("range", F.lit(PARTS)))
        blocks.repartition("folder", "part").drop("part").sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(f"{at}/postings")
        n, length = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._commit([*self.segments, {"id": number, "docs": n, "length": length}], self.deletions)

    def delete(self, ords: DataFrame) -> int:
        """Documents by ord, the one column of ords; how many were deleted."""
        number = self._next()
        path = f"{self.path}/deletions/{number}"
        asked = ords.select(F.col(ords.columns[0]).cast("long").alias("ord")).distinct()
        self.documents().join(asked, "ord", "left_semi").select("segment", "ord", "dl").write.parquet(path)
        n, length = self.spark.read.schema(DELETED).parquet(path).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            self._commit(self.segments, [*self.deletions, {"id": number, "docs": n, "length": length}])
        return n

    def compact(self) -> None:
        """All live documents in one segment, without deletions.  Ranges stay those of their segments."""
        number = self._next()
        at, wide = f"{self.path}/segments/{number}", F.col("segment").cast("long") * (1 << 48) + F.col("range")
        self.documents().select("ord", "dl", wide.alias("range")).write.parquet(f"{at}/documents")
        each = self._live(self.blocks().select("segment", "range", "folder", "term", F.explode("held").alias("h")).select("segment", "range", "folder", "term", "h.*"))
        each = each.select("folder", "term", wide.alias("range"), "ord", "tf", "dl").withColumn("part", F.pmod("range", F.lit(PARTS)))
        blocks = each.repartition("folder", "part").groupBy("folder", "part", "term", "range").agg(
            F.sort_array(F.collect_list(F.struct("ord", "tf", "dl"))).alias("held"), F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl")
        )
        blocks.drop("part").sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(f"{at}/postings")
        self._commit([{"id": number, "docs": self.n_docs, "length": self.length}], [])

    # Reading.

    @property
    def n_docs(self) -> int:
        return sum(s["docs"] for s in self.segments) - sum(d["docs"] for d in self.deletions)

    @property
    def length(self) -> int:
        return sum(s["length"] for s in self.segments) - sum(d["length"] for d in self.deletions)

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = None
        for s in self.segments:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s['id']}/{kind}").withColumn("segment", F.lit(s["id"]))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema + ", segment int") if out is None else out

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows, which have segment and ord, without what was deleted."""
        if not self.deletions:
            return rows
        gone = self.spark.read.schema(DELETED).parquet(*(f"{self.path}/deletions/{d['id']}" for d in self.deletions)).select("segment", "ord")
        return rows.join(joinable(gone, sum(d["docs"] for d in self.deletions)), ["segment", "ord"], "left_anti")

    def documents(self) -> DataFrame:
        """segment, ord, dl and range of the live documents."""
        return self._live(self._read("documents", DOCUMENTS))

    def blocks(self) -> DataFrame:
        return self._read("postings", BLOCKS)

    def held(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms of asked, a stored table; stored, so that the index is read once, and these alone later."""
        wanted = asked.select("term").distinct().withColumn("folder", F.pmod(F.hash("term"), F.lit(FOLDERS)))
        return stored(self.blocks().join(joinable(stored(wanted, "wanted")), ["folder", "term"]), "held")

    def terms(self, asked: DataFrame) -> DataFrame:
        """term, folder, df and idf of the terms of asked, a stored table, that live documents hold."""
        return self._terms(self.held(asked))

    def _terms(self, met: DataFrame) -> DataFrame:
        if self.deletions:
            met = self._live(met.select("segment", "folder", "term", F.explode("held.ord").alias("ord"))).withColumn("n", F.lit(1))
        df = met.groupBy("folder", "term").agg(F.sum("n").alias("df"))
        return df.withColumn("idf", bm25_idf(F.lit(float(self.n_docs)), F.col("df")))


def _weights(wanted: DataFrame, blocks: DataFrame, ranges: DataFrame | None, few: bool) -> DataFrame:
    """query_id, segment, range, block and what the query asks of its term.  ranges: query_id, segment, range."""
    if ranges is None:
        return blocks.join(joinable(wanted) if few else wanted, ["folder", "term"])
    asked = ranges.join(joinable(wanted) if few else wanted, "query_id")
    return blocks.join(joinable(stored(asked, "asked-blocks")), ["folder", "term", "segment", "range"])


def search(queries: DataFrame, index: Index, k: int = 5, k1: float = 1.5, b: float = 0.75, pad: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ranking of bm25() over the index's documents, and how many blocks each query has and has read (query_id,
    blocks, read).  queries: query_id and tokens."""
    with own_tables() as own:
        asked = stored(term_counts(queries, "tokens", "query_id").withColumnRenamed("tf", "qtf"), "asked")
        avgdl = F.lit(index.length / index.n_docs if index.n_docs else 0.0)
        held = index.held(asked)
        wanted = asked.join(index._terms(held), "term").select("query_id", "folder", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        wanted = stored(wanted, "wanted")
        few = wanted.count() <= 1_000_000
        named = held.drop("held")
        bound = bm25_weight(F.col("most_tf"), F.col("least_dl"), F.col("w"), avgdl, k1, b)
        bounds = _weights(wanted, named, None, few).groupBy("query_id", "segment", "range").agg(F.sum(bound).alias("bound"), F.count("*").alias("blocks"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
        bounds = stored(bounds.withColumn("place", F.row_number().over(order)), "bounds")
        found = read = None
        steps = [0, *ROUNDS, None]
        for low, high in zip(steps, steps[1:]):
            open_now = bounds.where(F.col("place") > low)
            if high is not None:
                open_now = open_now.where(F.col("place") <= high)
            if found is not None:
                # A bound and a score are sums of the same size, so both are rounded before they are compared.
                least = top(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
                open_now = open_now.join(stored(least, "least"), "query_id", "left").where(F.col("least").isNull() | (F.round("bound", DIGITS) + 10.0**-DIGITS >= F.col("least")))
            open_now = stored(open_now.select("query_id", "segment", "range", "blocks"), "open")
            if found is not None and not open_now.limit(1).count():
                continue
            met = _weights(wanted, held, open_now.drop("blocks"), few).select("query_id", "segment", "w", F.explode("held").alias("h"))
            met = index._live(met.select("query_id", "segment", "w", "h.ord", "h.tf", "h.dl"))
            weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("w"), avgdl, k1, b)
            part = met.groupBy("query_id", "ord").agg(F.round(F.sum(weight), DIGITS).alias("score"))
            part = stored(top(part, k).drop("rank"), "scored")
            found = part if found is None else found.unionByName(part)
            read = open_now if read is None else read.unionByName(open_now)
        every = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
        report = stored(every.join(read.groupBy("query_id").agg(F.sum("blocks").alias("read")), "query_id", "left"), "report")
        ranked = stored(top(padded(found, queries, index.documents(), k) if pad else found, k), "ranked")
    kept = [*ranked.inputFiles(), *report.inputFiles()]
    remove(queries.sparkSession, [p for p in own if not any(p in f for f in kept)])
    return ranked, report
