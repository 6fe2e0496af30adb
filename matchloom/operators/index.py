"""Term indexes: postings, document frequencies, corpus statistics, weights.

Documents of equal content share a rep, a digest of it, so they are counted, weighed and scored once.  The first step
deals documents by rep; term counts, norms and, with broadcast queries, scores follow without another shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources.shared import stored

#: Rows of a table of terms that are broadcast at most, counted first; beyond, the join shuffles.
BROADCAST_TERMS = 1_000_000


def term_counts(docs: DataFrame, terms: str, *keys: str) -> DataFrame:
    """keys, term and tf."""
    return docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, terms: str = "tokens") -> DataFrame:
    """n_docs and avgdl, in one row; empty documents count."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(terms)).alias("avgdl"))


def joinable(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small, a stored table, to be broadcast if its rows, counted first, are few enough."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_TERMS else small


def rep_of(content: Column) -> Column:
    return F.unhex(F.md5(content))


def keyed(docs: DataFrame, content: str, rep: Column) -> DataFrame:
    """ord, content, rep and row, a number of its own, stored: the content may have cost much to make, and is read several
    times."""
    return stored(docs.select("ord", content, rep.alias("rep"), F.monotonically_increasing_id().alias("row")), "keyed")


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared(named: DataFrame, content: str) -> DataFrame:
    """rep, content, copies and first, the least ord, of the distinct documents, dealt by rep and first.  named: a table of
    keyed().

    Spark gathers a shuffle of few bytes in few tasks, but few documents may still meet many queries: so distinct ones are
    dealt out to as many tasks as a shuffle has, however many rows they stand for."""
    reps = named.groupBy("rep").agg(F.count("*").alias("copies"), F.min("ord").alias("first"), F.min("row").alias("of_row"))
    reps = stored(reps.withColumnRenamed("rep", "of_rep"), "reps")
    few = joinable(reps)
    rows = named if few is not reps else named.repartition(tasks(named), "rep", "row")
    # One row of each brings the content; both keys, so that copies of one text are no heavy key.
    one = rows.join(few, (F.col("rep") == F.col("of_rep")) & (F.col("row") == F.col("of_row"))).select("rep", content, "copies", "first")
    return one.repartition(tasks(named), "rep", "first")


def bm25_idf(n: Column, df: Column) -> Column:
    half, one = F.lit(0.5), F.lit(1.0)
    return F.log((n - df + half) / (df + half) + one)


def bm25_weight(tf: Column, dl: Column, idf: Column, avgdl: Column, k1: float, b: float) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return idf * tf * F.lit(k1 + 1.0) / (tf + norm)


@dataclass
class Bm25Index:
    """postings: term, ord, tf, dl, weight; terms: term, df, idf."""

    postings: DataFrame
    terms: DataFrame


def with_counts(docs: DataFrame, terms: str, out: str) -> DataFrame:
    """docs with out, an array of term and tf, in place of terms, whose equal ones stand in a row once sorted: nothing is
    shuffled or kept for it.  Null terms drop out."""
    at = lambda i: F.element_at("_sorted", i)
    rows = docs.withColumn("_sorted", F.sort_array(F.array_compact(terms))).drop(terms)
    places = F.when(F.size("_sorted") > 0, F.sequence(F.lit(1), F.size("_sorted"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", F.filter(places, lambda i: F.when(i == 1, True).otherwise(at(i) != at(F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), F.array(F.size("_sorted") + 1))
    pairs = F.zip_with("_starts", ends, lambda a, b: F.struct(at(a).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.withColumn(out, F.when(F.size("_starts") > 0, pairs).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))).drop("_sorted", "_starts")


def frequent(terms: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Those of terms, a stored table with df, that are held most often, at most BROADCAST_TERMS; the rest; how many those are."""
    size = F.floor(F.log2("df"))
    counts = {r.size: r.n for r in terms.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # 60 rows at most
    rows, least = 0, max(counts, default=0) + 1
    while least - 1 in range(max(counts, default=0) + 1) and rows + counts.get(least - 1, 0) <= BROADCAST_TERMS:
        least -= 1
        rows += counts.get(least, 0)
    return terms.where(size >= least), terms.where(size < least), sum(n for s, n in counts.items() if s < least)


def bm25_index(docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    """docs: ord and tokens.  The weight of a posting is a document's whole share in a score per query occurrence.  Texts
    are read once; postings of frequent terms meet them where they lie, only those of the others are shuffled."""
    rows = docs.select("ord", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    # A null after the terms is a document's row, from which number and mean length come.
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")))
    each = with_counts(rows, "tokens", "counts").select("ord", "dl", F.explode(F.concat("counts", none)).alias("c"))
    counts = stored(each.select("ord", "dl", "c.term", "c.tf"), "counts")
    n, length = F.count("*"), F.sum("dl")
    stats = counts.where("term IS NULL").agg(F.struct(n.alias("n_docs"), (length / n).alias("avgdl"))).scalar()
    counts = counts.where("term IS NOT NULL")
    terms = stored(counts.groupBy("term").agg(F.count("*").alias("df")), "terms").withColumn("c", stats)
    terms = terms.withColumn("idf", bm25_idf(F.col("c.n_docs"), F.col("df")))
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("c.avgdl"), k1, b)
    often, others, rest = frequent(terms)
    met = counts.join(F.broadcast(often.withColumnRenamed("term", "of")), F.col("term") == F.col("of"), "left")
    postings = met.where("of IS NOT NULL").select("term", "ord", "tf", "dl", weight.alias("weight"))
    if rest:
        rare = met.where("of IS NULL").select("term", "ord", "tf", "dl").join(others, "term")
        postings = postings.unionByName(rare.select("term", "ord", "tf", "dl", weight.alias("weight")))
    return Bm25Index(postings, terms.select("term", "df", "idf"))


@dataclass
class TfidfIndex:
    """counts: rep, first, term, tf, dealt by rep; terms: term, idf, a stored table; copies: rep, ord; rare: the idf of
    a term that only one document has."""

    counts: DataFrame
    terms: DataFrame
    copies: DataFrame
    rare: float


def tfidf_index(docs: DataFrame, terms_of, text: str = "doc") -> TfidfIndex:
    """docs: ord and a normal text; terms_of: Column of text -> array of terms."""
    named = keyed(docs, text, rep_of(F.col(text)))
    # An outer explode: of an inner one Spark makes a filter on the terms, and makes those of all copies for it.
    each = with_counts(shared(named, text).withColumn("terms", terms_of(F.col(text))), "terms", "counts")
    each = each.select("rep", "copies", "first", F.explode_outer("counts").alias("c")).where("c IS NOT NULL")
    counts = each.select("rep", "copies", "first", "c.term", "c.tf")
    n = named.count()
    terms = counts.groupBy("term").agg(F.sum("copies").alias("df"))
    terms = stored(terms.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "terms")
    rare = docs.sparkSession.range(1).select(F.log(F.lit((1.0 + n) / 2.0)) + 1.0).first()[0]
    return TfidfIndex(counts.drop("copies"), terms, named.select("rep", "ord"), rare)


def raw_weights(index: TfidfIndex) -> DataFrame:
    """rep, first, term and w: sublinear tf times idf, before the norm.  Most terms are of one document and have one idf.
    The table of the others is broadcast where it can be, and then the counts stay dealt by rep; else that of the most
    frequent is, and only counts of the rest are shuffled."""
    often, others, rest = frequent(index.terms.where("df > 1"))
    met = index.counts.join(F.broadcast(often.select(F.col("term").alias("of"), "idf")), F.col("term") == F.col("of"), "left")
    w = lambda idf: ((1.0 + F.log("tf")) * idf).alias("w")
    rare = F.lit(index.rare)
    if not rest:
        return met.select("rep", "first", "term", w(F.coalesce("idf", rare)))
    known = met.where("of IS NOT NULL").select("rep", "first", "term", w(F.col("idf")))
    left = met.where("of IS NULL").select("rep", "first", "term", "tf")
    left = left.join(others.select(F.col("term").alias("of"), "idf"), F.col("term") == F.col("of"), "left")
    return known.unionByName(left.select("rep", "first", "term", w(F.coalesce("idf", rare))))


def unit_weights(index: TfidfIndex) -> DataFrame:
    """rep, first, term and w, of unit length over a rep's terms: the whole index, to be stored by whoever asks it often."""
    whole = raw_weights(index).groupBy("rep", "first").agg(F.collect_list(F.struct("term", "w")).alias("ts"))
    norm = F.sqrt(F.aggregate("ts", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    parted = whole.withColumn("norm", norm).select("rep", "first", "norm", F.explode("ts").alias("t"))
    return parted.select("rep", "first", "t.term", (F.col("t.w") / F.col("norm")).alias("w"))


def query_weights(queries: DataFrame, terms: DataFrame, terms_of, text: str = "doc") -> DataFrame:
    """query_id, term and wq, of unit length per query.  Terms outside the vocabulary drop out first."""
    asked = term_counts(queries.withColumn("terms", terms_of(F.col(text))), "terms", "query_id")
    raw = asked.join(terms.select("term", "idf"), "term").select("query_id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    whole = raw.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("ts"))
    norm = F.sqrt(F.aggregate("ts", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    parted = whole.withColumn("norm", norm).select("query_id", "norm", F.explode("ts").alias("t"))
    return parted.select("query_id", "t.term", (F.col("t.w") / F.col("norm")).alias("wq"))
