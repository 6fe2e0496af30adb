import pytest
from matchloom import cli
from matchloom.functions import text as T
from matchloom.operators import docs, embed
from matchloom.sources import files
from matchloom.streaming import match
from pyspark.sql import functions as F

ROWS = [("07891", "Suco de uva 1L", "Alfa"), ("07892", "Suco de laranja, 1L", None), ("07893", "Água sem gás 500ml Beta", "beta"), ("07894", "Refrigerante laranja 2L", "Alfa")]


def folder(spark, tmp_path):
    (tmp_path / "catalog.csv").write_text("product_id,product_name,brand_name\n" + "".join(f'{i},"{n}",{b or ""}\n' for i, n, b in ROWS))
    (tmp_path / "queries_val.csv").write_text('text,matched_id\n"SUCO UVA 1L C/6",07891\n"suco, laranja",07892\nAGUA S/GAS 500 ML,07893\nREFRI LARANJA 2LT,07894\n')
    (tmp_path / "queries.csv").write_text("text,matched_id\nSUCO UVA 1L C/6,\nCHICLETE BUZZY,\n")
    return str(tmp_path)


def test_catalogue(spark, tmp_path):
    got = cli.catalogue(spark, folder(spark, tmp_path)).orderBy("ord").collect()
    assert [r.product_id for r in got] == [i for i, *_ in ROWS]
    assert [r.doc for r in got] == ["suco uva 1l alfa", "suco laranja 1l", "agua sem gas 500ml beta", "refrigerante laranja 2l alfa"]


def test_evaluate_fill_profile_probe(spark, tmp_path, capsys):
    data = folder(spark, tmp_path)
    cli.main(["evaluate", "--data", data, "--method", "all", "--out", str(tmp_path / "details")])
    said = capsys.readouterr().out
    assert said.count("P@1=1.000") == 3, said
    rows = files.read_details(spark, str(tmp_path / "details" / "details_bm25_val")).collect()
    assert len(rows) == 4 and all(r.top5[0].id == r.gold_id for r in rows)
    cli.main(["fill", "--data", data, "--out", str(tmp_path / "filled"), "--threshold", "0.3"])
    filled = {r.text: r for r in spark.read.option("header", True).csv(str(tmp_path / "filled")).collect()}
    assert filled["SUCO UVA 1L C/6"].matched_id == "07891" and filled["CHICLETE BUZZY"].matched_id is None
    cli.main(["profile", "--data", data])
    cli.main(["probe", "--data", data, "--out", str(tmp_path / "probe")])
    assert "MORMAII" in spark.read.text(str(tmp_path / "probe"), wholetext=True).first()[0]


def toy_model():
    """Vectors of letter counts."""
    return lambda texts: [[1.0 + t.count(c) for c in "abcdefghijklmnopqrstuvwxyz0125"] for t in texts]


def test_neural_rankers_report_and_probes(spark, tmp_path, capsys):
    data, cache = folder(spark, tmp_path), str(tmp_path / "cache")
    neural = ["--data", data, "--embedder", "tests.test_io:toy_model", "--cache", cache]
    cli.main(["evaluate", *neural, "--method", "all", "--raw-text"])
    cli.main(["evaluate", *neural, "--method", "hybrid"])
    said = capsys.readouterr().out
    assert said.count("dense") == 1 and said.count("hybrid") == 2 and said.count("n=4") == 6, said
    assert len(list((tmp_path / "cache").iterdir())) == 1  # one store a model, of raw texts and normal ones
    cli.main(["report", *neural, "--out", str(tmp_path / "report")])
    said = capsys.readouterr().out
    assert "## tfidf_char: 4 of 4 right" in said and "## hybrid" in said and "## Ambiguous" in said and "of both: 0" in said
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0].startswith("## tfidf_char")
    cli.main(["probe", *neural, "--method", "all"])
    said = capsys.readouterr().out
    assert all(said.count(f"| {n} |") == 9 for n in ("tfidf_char", "tfidf_word", "bm25", "dense", "hybrid")) and said.count("| control |") == 10
    cli.main(["evaluate", "--data", data, "--embedder", "hashed", "--method", "all"])
    said = capsys.readouterr().out
    assert said.count("dense") == 1 and said.count("hybrid") == 1 and said.count("n=4") == 5, said
    with pytest.raises(SystemExit):
        cli.main(["probe", "--data", data, "--method", "dense"])


def test_a_broken_write_of_vectors_is_written_anew(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "doc string")
    encode = lambda d: d.selectExpr("doc", "array(1f) AS v")
    assert files.cached_embeddings(df, "m", encode, str(tmp_path)).count() == 2
    kept = tmp_path / files.content_key(df, "m")
    (kept / "_SUCCESS").unlink()
    next(kept.glob("part-*")).unlink()
    assert files.cached_embeddings(df, "m", encode, str(tmp_path)).count() == 2


def test_order_of_a_file_of_several_parts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name\n" + "".join(f"n{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = docs.with_order(spark.read.option("header", True).csv(str(tmp_path / "x.csv")))
        got = {r.name: r.ord for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"n{i}": i for i in range(5000)}
    assert docs.with_order(df.drop("ord").limit(0)).count() == 0


def test_holders_are_those_that_contain(spark):
    import random

    rng = random.Random(2)
    words = ["ab", "cd", "ef", "gh"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    asked = [t[rng.randrange(5) : rng.randrange(6, 60)] for t in texts if len(t) > 70] + ["ab", "", "zz", "ab cd ef gh ab cd ef gh zz"]
    df = lambda rows, n: spark.createDataFrame(list(enumerate(rows)), f"{n} long, text string").withColumn("tokens", T.simple_tokens(F.col("text")))
    got = {(r.query_id, r.ord) for r in docs.holders(df(asked, "query_id"), df(texts, "ord")).collect()}
    assert got == {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a in t}


def test_last_name_of_an_id_wins(spark):
    df = docs.with_order(spark.createDataFrame([("1", "a"), ("1", "b")], "product_id string, product_name string").coalesce(1))
    assert docs.id_names(df).first().product_name == "b"


def test_embedding_store(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "doc string")
    calls = []

    def encode(d):
        calls.append(1)
        return d.selectExpr("doc", "array(1f) AS v")

    for frame in (df, df.repartition(3)):
        assert files.cached_embeddings(frame, "m", encode, str(tmp_path)).count() == 2
    assert len(calls) == 1
    files.cached_embeddings(df, "other", encode, str(tmp_path))
    assert len(calls) == 2


def test_only_new_texts_are_encoded(spark, tmp_path):
    asked = []

    def encode(d):
        asked.append(sorted(r.doc for r in d.select("doc").collect()))
        return d.withColumn("v", F.array(F.length("doc").cast("float")))

    def vectors(*texts, model="m"):
        df = spark.createDataFrame([(t, 1) for t in texts], "doc string, digit int").repartition(3)
        rows = [tuple(r) for r in files.stored_embeddings(df, model, encode, str(tmp_path)).collect()]
        return sorted((t, list(v)) for t, v in rows)

    assert vectors("a", "bb", "", "a", None) == [("", [0.0]), ("a", [1.0]), ("bb", [2.0])]
    assert vectors("a", "bb") == [("a", [1.0]), ("bb", [2.0])]
    assert vectors("a", "ccc", "bb") == [("a", [1.0]), ("bb", [2.0]), ("ccc", [3.0])]
    assert vectors() == [] and asked == [["", "a", "bb"], ["ccc"]]
    assert vectors("a", model="other") == [("a", [1.0])] and asked[2:] == [["a"]]
    # A part that is lost is encoded again; rows that stand twice count once.
    (store,) = [p for p in tmp_path.iterdir() if len(spark.read.parquet(str(p)).collect()) == 4]
    twice = spark.read.parquet(str(store)).collect()
    spark.createDataFrame(twice, "digest binary, v array<float>").write.mode("append").parquet(str(store))
    assert vectors("a", "ccc") == [("a", [1.0]), ("ccc", [3.0])]
    for part in store.glob("part-*"):
        part.unlink()
    assert vectors("a", "ccc") == [("a", [1.0]), ("ccc", [3.0])] and asked[3:] == [["a", "ccc"]]


def test_a_worker_loads_a_model_once(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            assert len(texts) <= 3 and (len(texts) == 1 or sum(map(len, texts)) <= 20)
            return [[float(len(t)), 0.0] for t in texts]

        return model

    df = spark.createDataFrame([("x" * (i % 30),) for i in range(200)], "doc string").repartition(24)
    for _ in range(2):
        rows = embed.from_model(df, load, batch=3, chars=20, name="once").collect()
        assert len(rows) == 200 and all(list(r.v) == [1.0 if r.doc else 0.0, 0.0] for r in rows)
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 24


def test_stream_equals_batch(spark, tmp_path):
    asked = spark.createDataFrame([(1, "SUCO UVA 1L C/6"), (2, "AGUA S/GAS 500ML")], "query_id long, text string")
    asked.write.parquet(str(tmp_path / "in"))
    products = cli.catalogue(spark, folder(spark, tmp_path)).select("ord", "doc")
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    match.match_stream(stream, products, T.char_wb, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r.query_id: r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: 2}
