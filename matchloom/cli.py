"""Command line: python -m matchloom.cli {evaluate,fill,profile,probe,report} ...

evaluate  measures rankers on labelled queries (--split val|test, --method, --no-brand, --raw-text)
fill      matches all queries to their best product and writes a CSV
profile   prints counts, lengths and frequent tokens of the catalogue and the queries
probe     shows the first matches of queries that have no product, and of controls, by one ranker or all
report    sets two rankers side by side (--classic, --deep): hits, errors, ambiguous queries, scores

--embedder module:function names a function without arguments that loads a model, that is, returns a function from a
list of texts to a list of vectors; with it there are the rankers dense and hybrid.  --cache is where the catalogue's
vectors are kept, by text.  --embedder hashed takes vectors of hashed n-grams, without a model or a cache.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions.tables import CONTROL_PROBES, NO_MATCH_PROBES, THRESHOLDS
from matchloom.operators import analysis, docs, embed, metrics, profile, rank
from matchloom.operators.report import qualitative
from matchloom.sources import files
from matchloom.sources.shared import stored


def word_pairs(doc):
    return T.with_bigrams(T.word_terms(doc))


def catalogue(spark: SparkSession, folder: str, brand: bool = True, raw: bool = False) -> DataFrame:
    ordered = docs.with_order(files.read_catalogue(spark, f"{folder}/catalog.csv"))
    return docs.with_documents(ordered, brand="brand_name" if brand else None, normalise=not raw)


def _tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.filter(F.split("doc", " "), lambda x: x != ""))


def _lower(df: DataFrame) -> DataFrame:
    """TF-IDF sees lower case, also where texts are left raw."""
    return df.withColumn("doc", F.lower("doc"))


LEXICAL = {
    "tfidf_char": lambda q, c, k: rank.tfidf(_lower(q), _lower(c), T.char_wb, k),
    "tfidf_word": lambda q, c, k: rank.tfidf(_lower(q), _lower(c), word_pairs, k),
    "bm25": lambda q, c, k: rank.bm25(_tokens(q), _tokens(c), k),
}


def rankers(a: argparse.Namespace) -> dict:
    """Name -> function of queries, catalogue and k."""
    if not a.embedder:
        return dict(LEXICAL)
    if a.embedder == "hashed":
        # No model: vectors of hashed n-grams, made by Spark as cheaply as a store would give them back.
        def hashed(df: DataFrame, out: str, key: str) -> DataFrame:
            return _tokens(df).join(embed.hashed(_lower(df), key, T.char_wb(F.col("doc")), out), key)

        return LEXICAL | {
            "dense": lambda q, c, k: rank.dense(hashed(q, "q", "query_id"), hashed(c, "v", "ord"), k),
            "hybrid": lambda q, c, k: rank.hybrid(hashed(q, "q", "query_id"), hashed(c, "v", "ord").select("ord", "tokens", "v"), k).drop("bm25_rank"),
        }
    module, function = a.embedder.split(":")
    load = getattr(importlib.import_module(module), function)

    def with_vectors(df: DataFrame, out: str) -> DataFrame:
        return embed.from_model(df, load, out=out, name=a.embedder)

    def encoded(c: DataFrame) -> DataFrame:
        texts = c.select("doc").distinct()
        kept = files.stored_embeddings(texts, a.embedder, lambda x: with_vectors(x, "v"), a.cache) if a.cache else with_vectors(texts, "v")
        return _tokens(c).join(kept, "doc").select("ord", "tokens", "v")

    return LEXICAL | {
        "dense": lambda q, c, k: rank.dense(with_vectors(q, "q"), encoded(c), k),
        "hybrid": lambda q, c, k: rank.hybrid(with_vectors(_tokens(q), "q"), encoded(c), k).drop("bm25_rank"),
    }


def _chosen(a: argparse.Namespace) -> dict:
    every = rankers(a)
    if a.method != "all" and a.method not in every:
        raise SystemExit(f"--method {a.method} needs --embedder")
    return every if a.method == "all" else {a.method: every[a.method]}


def _queries(spark: SparkSession, texts: DataFrame, raw: bool = False) -> DataFrame:
    numbered = docs.with_order(texts, "query_id")
    return numbered.withColumn("doc", F.coalesce("text", F.lit(""))) if raw else T.with_normalised(numbered, "text")


def _inputs(spark: SparkSession, a: argparse.Namespace):
    """Catalogue, queries and gold, computed once."""
    products = stored(catalogue(spark, a.data, not a.no_brand, a.raw_text), "catalogue")
    asked = stored(_queries(spark, files.read_labelled(spark, a.data, a.split), a.raw_text), "queries")
    by_id = products.groupBy("product_id").agg(F.max("ord").alias("gold"))
    return products, asked, asked.join(by_id, F.col("matched_id") == F.col("product_id"), "left").select("query_id", "gold")


def _names(products: DataFrame) -> DataFrame:
    return products.select("ord", F.col("product_id").alias("id"), F.col("product_name").alias("name"))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    products, asked, gold = _inputs(spark, a)
    for name, ranker in _chosen(a).items():
        measured, ranked = metrics.evaluate(lambda q, k, ranker=ranker: ranker(q, products, k), asked, gold)
        print(f"{name:<11} P@1={measured['p1']:.3f} MRR@5={measured['mrr']:.3f} R@5={measured['recall']:.3f} n={measured['n']} seconds={measured['seconds']}")
        if a.out:
            rows = analysis.nested(ranked, asked.select("query_id", "text"), gold, _names(products))
            files.write_details(rows.drop("query_id").withColumnRenamed("top", "top5"), f"{a.out}/details_{name}_{a.split}")


def fill(spark: SparkSession, a: argparse.Namespace) -> None:
    products, asked = catalogue(spark, a.data), _queries(spark, files.read_csv(spark, f"{a.data}/queries.csv", files.LABELLED))
    best = rank.best_match(asked, products, T.char_wb).join(products.select("ord", "product_id"), "ord", "left")
    out = asked.select("query_id", "text").join(best, "query_id", "left").orderBy("query_id")
    out = out.select("text", F.col("product_id").alias("matched_id"), F.round("score", 4).alias("score"))
    out = stored(out, "filled")
    files.write_csv(metrics.rejected(out, a.threshold) if a.threshold is not None else out, a.out)
    metrics.described(out).show()
    metrics.below_thresholds(out, THRESHOLDS).show()


def show_profile(spark: SparkSession, a: argparse.Namespace) -> None:
    products, asked = files.read_catalogue(spark, f"{a.data}/catalog.csv"), files.read_labelled(spark, a.data, a.split)
    profile.row_counts({"catalogue": products, "queries": asked}).show()
    profile.distinct_counts(products, *products.columns).show()
    profile.null_counts(products, *products.columns).show()
    profile.top_values(products, "brand_name", 15).show()
    profile.top_values(products.select(profile.first_word(F.col("product_name")).alias("category")), "category", 15).show()
    profile.lengths(asked, "text").show()
    profile.top_values(profile.upper_tokens(asked, "text"), "token", 30).show(30)
    profile.top_values(profile.pack_tokens(asked, "text"), "token", 15).show()
    profile.label_cover(asked, products, "matched_id", "product_id").show()
    profile.upper_share(asked, "text").show()


def probe(spark: SparkSession, a: argparse.Namespace) -> None:
    products = stored(catalogue(spark, a.data), "catalogue")
    texts = spark.createDataFrame(list(enumerate([*NO_MATCH_PROBES, *CONTROL_PROBES])), "query_id long, text string")
    ranked = {n: r(T.with_normalised(texts, "text"), products, 3) for n, r in _chosen(a).items()}
    table = analysis.probe_tables(ranked, products.select("ord", F.col("product_name").alias("name"))).join(texts, "query_id")
    control = F.when(F.col("query_id") < len(NO_MATCH_PROBES), "none").otherwise("control")
    table = table.withColumn("product", control).orderBy("query_id", "method")
    report = files.markdown(table, {"text": "query", "product": "product", "method": "ranker", "names": "first matches", "scores": "scores"})
    print(report)
    if a.out:
        files.write_text(spark, report, a.out)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    products, asked, gold = _inputs(spark, a)
    every = rankers(a)
    names = [a.classic, a.deep or ("hybrid" if "hybrid" in every else "bm25")]
    ranked = {n: stored(every[n](asked, products, 5), "ranked") for n in names}
    text = qualitative(ranked, asked.select("query_id", "text"), gold, _names(products))
    print(text)
    if a.out:
        files.write_text(spark, text, a.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["evaluate", "fill", "profile", "probe", "report"])
    p.add_argument("--data", required=True, help="folder with catalog.csv, queries.csv, queries_val.csv, queries_test.csv")
    p.add_argument("--out", help="folder or file for results")
    p.add_argument("--split", choices=["val", "test"], default="val")
    p.add_argument("--method", choices=[*LEXICAL, "dense", "hybrid", "all"], default="tfidf_char")
    p.add_argument("--classic", default="tfidf_char", help="report: the first ranker")
    p.add_argument("--deep", help="report: the second ranker; hybrid, or bm25 where there is no embedder")
    p.add_argument("--embedder", help="module:function that loads a model, or hashed: hashed n-grams in its place")
    p.add_argument("--cache", help="folder of the catalogue's vectors")
    p.add_argument("--no-brand", action="store_true")
    p.add_argument("--raw-text", action="store_true", help="no normalisation, of either side")
    p.add_argument("--threshold", type=float, help="fill: leave matches with a lower score open")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("matchloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"evaluate": evaluate, "fill": fill, "profile": show_profile, "probe": probe, "report": report}[a.command](spark, a)


if __name__ == "__main__":
    main()
