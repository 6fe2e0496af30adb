"""TF-IDF over long texts, whose pairs of words are too many to count by shuffling them: all numbers that a ranking needs
are exact, others are bounded.

A document's norm needs the frequency of each of its terms.  Terms are counted by places of a digest, a fixed number of
them, where a term is held by as many documents at most as its place.  That makes a least idf of each term, a least norm
and so a greatest score of each document, from numbers alone.  Norms are then taken exactly, from exact frequencies of
all terms, of the documents whose greatest score reaches the k-th score of a query; the others cannot be among its best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.index import joinable, keyed, rep_of, tasks, term_counts, with_counts
from matchloom.operators.rank import DIGITS, SLACK, finished, top
from matchloom.sources.shared import stored

#: Places that terms are counted by, and bits of the filter of terms, of 64 bits a place; powers of two.  Fewer make bounds and filter
#: looser, and never change a result.
PLACES, MARKS = 1 << 22, 1 << 26
#: Places that are gathered in one row on the way to an array of all.
BLOCK = 1 << 12
#: Documents of each query, of the greatest bounds, whose norms are taken first: they give its k-th score.
FIRST = 20


def _dense(rows: DataFrame, name: str) -> Column:
    """The values of rows (place, value; each place once) by place, as one array that all tasks hold."""
    blocks = rows.groupBy(F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("b"))
    blocks = blocks.select(F.struct("block", F.col("b.value").alias("values")).alias("b"))
    one = blocks.agg(F.sort_array(F.collect_list("b")).alias("bs"))
    return stored(one.select(F.flatten("bs.values").alias("values")), name).scalar()


def _place(places: int) -> Column:
    return F.xxhash64("term").bitwiseAND(F.lit(places - 1))


def _counts(rows: DataFrame, terms_of) -> DataFrame:
    """row, term and tf.  rows: row and words."""
    each = with_counts(rows.select("row", terms_of(F.col("words")).alias("terms")), "terms", "counts")
    return each.select("row", F.explode_outer("counts").alias("c")).where("c IS NOT NULL").select("row", "c.term", "c.tf")


def _held(rows: DataFrame, terms_of) -> DataFrame:
    """term, a row for each document that holds it.  rows: words."""
    terms = rows.select(F.array_distinct(terms_of(F.col("words"))).alias("terms"))
    return terms.select(F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def _places(df: DataFrame, n: int, value: Column) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").alias("place"), value.alias("value"))


def _idf(n: int, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def least_idf(named: DataFrame, terms_of, n: int) -> Column:
    """An array by place: what the idf of the place's terms is at least."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = _held(named, terms_of).select(_place(PLACES).alias("place"), one.alias("value")).unionByName(_places(named, PLACES, none))
    most = F.least(F.sum("value"), F.lit(n))
    # A float may lie above the number it stands for, by far less than is taken off.
    least = each.groupBy("place").agg((_idf(n, most) * (1 - 1e-6)).cast("float").alias("value"))
    return _dense(least, "least-idf")


def norms(named: DataFrame, terms_of, rows: DataFrame, n: int) -> DataFrame:
    """head and norm, exact and stored, of the documents whose numbers are rows' head, a stored table."""
    counts = stored(_counts(named.join(joinable(rows), F.col("row") == F.col("head"), "left_semi"), terms_of), "picked")
    wanted = stored(counts.select("term").distinct(), "wanted")
    place, bit = _place(MARKS), F.col("mark").bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(place.alias("mark")).select(F.shiftright("mark", 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("value"))
    bits = bits.unionByName(_places(named, MARKS >> 6, F.lit(0).cast("long"))).groupBy("place").agg(F.bit_or("value").alias("value"))
    marks = _dense(bits, "marks")
    # The filter lets all wanted terms through, and a few others, which the join drops.
    passed = _held(named, terms_of).withColumn("mark", place).where(F.getbit(F.get(marks, F.shiftright("mark", 6).cast("int")), bit) == 1)
    df = passed.groupBy("term").agg(F.count("*").alias("df")).withColumnRenamed("term", "of")
    met = counts.join(df, F.col("term") == F.col("of")).withColumn("w", (1.0 + F.log("tf")) * _idf(n, F.col("df")))
    return stored(met.groupBy(F.col("row").alias("head")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")


def tfidf(queries: DataFrame, docs: DataFrame, words_of, terms_of, k: int = 5, text: str = "doc", pad: bool = True) -> DataFrame:
    """The ranking of rank.tfidf().  words_of: Column of text -> array of words, which are made and stored once; terms_of:
    Column of words -> array of terms."""
    named = keyed(docs.withColumn("words", words_of(F.col(text))), "words", rep_of(F.col(text)))
    n = named.count()
    # Copies are counted, but the first row of each text alone is scored.
    heads = stored(named.groupBy("rep").agg(F.min("ord").alias("first"), F.min("row").alias("head")), "heads")
    asked = stored(term_counts(queries.withColumn("terms", terms_of(words_of(F.col(text)))), "terms", "query_id").withColumnRenamed("term", "of"), "asked")
    vocabulary = stored(asked.select("of").distinct().withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    # A row of each asked term of a document, and one, without a number, of what the squares of all its others make at least.
    known = joinable(vocabulary)
    least = (1.0 + F.log("tf")) * F.get(least_idf(named, terms_of, n), _place(PLACES).cast("int"))
    each = _counts(named, terms_of).join(known, F.col("term") == F.col("of"), "left")
    met = each.groupBy("row", "number").agg(F.max("tf").alias("tf"), F.sum(F.when(F.col("number").isNull(), least * least)).alias("rest"))
    met = stored(met, "met")
    idf = met.where("number IS NOT NULL").groupBy("number").agg(F.count("*").alias("df")).select("number", _idf(n, F.col("df")).alias("idf"))
    raw = stored(asked.join(known, "of").join(idf, "number").select("query_id", "number", "idf", ((1.0 + F.log("tf")) * F.col("idf")).alias("w")), "raw")
    whole = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    wanted = stored(raw.join(whole, "query_id").select("query_id", F.col("number").alias("asked"), (F.col("w") / F.col("norm")).alias("wq")), "wanted")
    idf = stored(raw.select(F.col("number").alias("asked"), "idf").distinct(), "idf")
    # Numbers alone, dealt by document, so that sums and each task's best need no other shuffle.
    own = met.join(joinable(heads.select("head"), heads.count()), F.col("row") == F.col("head"), "left_semi").repartition(tasks(docs), "row")
    w, same = (1.0 + F.log("tf")) * F.col("idf"), F.col("number") == F.col("asked")
    squares = F.sum(F.coalesce("rest", w * w)).over(Window.partitionBy("row"))
    own = own.join(joinable(idf), same, "left").select("row", "number", w.alias("w"), F.sqrt(squares).alias("norm")).where("number IS NOT NULL")
    dots = own.join(joinable(wanted), same).groupBy("row", "query_id").agg(F.sum(F.col("wq") * F.col("w")).alias("dot"), F.max("norm").alias("norm"))
    most = dots.select("query_id", F.col("row").alias("ord"), "dot", (F.col("dot") / F.col("norm")).alias("score"))

    def scored(rows: DataFrame, exact: DataFrame) -> DataFrame:
        met = rows.join(joinable(exact), F.col("ord") == F.col("head"))
        return met.select("query_id", "ord", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("score"))

    first = stored(top(most, max(k, FIRST), keep=("dot",)), "first")
    exact = norms(named, terms_of, stored(first.select(F.col("ord").alias("head")).distinct(), "first-heads"), n)
    reached = top(scored(first, exact), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # A query without a k-th score has few matches, and keeps them all.
    near = most.join(joinable(stored(reached, "reached")), "query_id", "left").where(F.coalesce(F.col("score") + SLACK >= F.col("least"), F.lit(True)))
    near = stored(near.select("query_id", "ord", "dot"), "near")
    more = stored(near.select(F.col("ord").alias("head")).distinct().join(exact, "head", "left_anti"), "more-heads")
    if more.limit(1).count():
        exact = stored(exact.unionByName(norms(named, terms_of, more, n)), "exact")
    best = stored(scored(near, exact), "scored")
    by_rep = heads.join(joinable(best), F.col("head") == F.col("ord")).select("query_id", "rep", "first", "score")
    return finished(by_rep, queries, docs, named.select("rep", "ord"), k, pad)
