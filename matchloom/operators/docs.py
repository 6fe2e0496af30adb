"""Catalogue documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import with_normalised
from matchloom.operators.index import joinable
from matchloom.sources.shared import stored


def with_documents(catalogue: DataFrame, name: str = "product_name", brand: str | None = "brand_name", normalise: bool = True) -> DataFrame:
    """catalogue with doc_raw, the name and, unless it holds it already (case aside), the brand, and doc, its normal
    form.  A null brand is no brand.  Without a brand column, or normalisation, the plainer variants."""
    label = F.coalesce(F.col(name), F.lit(""))
    if brand is None:
        out = catalogue.withColumn("doc_raw", label)
    else:
        mark = F.coalesce(F.col(brand), F.lit(""))
        apart = (mark != "") & ~F.contains(F.lower(label), F.lower(mark))
        out = catalogue.withColumn("doc_raw", F.when(apart, F.concat_ws(" ", label, mark)).otherwise(label))
    return with_normalised(out, "doc_raw") if normalise else out.withColumn("doc", F.col("doc_raw"))


def with_order(df: DataFrame, column: str = "ord") -> DataFrame:
    """df with its rows' places in the file order of a source that has one; ties in rankings go by it.  Rows know their
    place in their partition; what comes before it is added from the partitions' counts, one number each."""
    numbered = df.withColumn(column, F.monotonically_increasing_id())
    part, place = F.shiftright(column, 33), F.col(column).bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += counts[p]
    return numbered.withColumn(column, place + F.coalesce(F.element_at(F.create_map(*offsets), part), F.lit(0)) if offsets else place)


def _windows(tokens: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def holders(queries: DataFrame, docs: DataFrame, anchor: int = 5) -> DataFrame:
    """query_id and ord of the documents whose text holds a query's text word for word.  queries: query_id, text, tokens;
    docs: ord, text, tokens.

    Whoever holds a text holds its inner words in a row: so documents meet queries by one run of anchor words of theirs,
    that which least queries share, and only those that meet are compared.  Queries too short for that are few words
    long; they are compared with all documents."""
    inner = F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0)))
    asked = stored(queries.select("query_id", F.col("text").alias("asked"), inner.alias("inner")).where("asked IS NOT NULL"), "asked")
    runs = asked.select("query_id", F.explode(_windows(F.col("inner"), anchor)).alias("run"))
    shares = runs.groupBy("run").agg(F.count("*").alias("n"))
    one = runs.join(shares, "run").groupBy("query_id").agg(F.min(F.struct("n", "run")).alias("least"))
    anchors = stored(one.select("query_id", F.col("least.run").alias("run")).join(asked.select("query_id", "asked"), "query_id"), "anchors")
    held = docs.select("ord", F.explode(F.array_distinct(_windows(F.col("tokens"), anchor))).alias("run"))
    met = held.join(joinable(anchors), "run").select("query_id", "asked", "ord")
    met = met.join(docs.select("ord", "text"), "ord")
    short = asked.where(F.size("inner") < anchor).select("query_id", "asked")
    met = met.select("query_id", "ord", "asked", "text").unionByName(docs.select("ord", "text").join(joinable(stored(short, "short")), F.contains("text", "asked")))
    return met.where(F.contains("text", "asked")).select("query_id", "ord").distinct()


def id_names(catalogue: DataFrame, id_col: str = "product_id", name: str = "product_name", order: str = "ord") -> DataFrame:
    """One name per id: that of the last row."""
    return catalogue.groupBy(id_col).agg(F.max_by(name, order).alias(name))
