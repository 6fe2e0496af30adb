import random

import pytest
from matchloom.operators import rank, store
from pyspark.sql import functions as F

WORDS = ["uva", "suco", "lata", "agua", "cola", "limao", "sem", "gas", "leite", "po", "mel", "cha"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.choice(WORDS[: rng.randint(2, len(WORDS))]) for _ in range(rng.randint(0, 12))]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(2)


def asked(spark):
    return spark.createDataFrame([(1, ["uva", "mel"]), (2, ["suco", "suco", "cha"]), (3, ["nowhere"]), (4, []), (5, WORDS)], "query_id long, tokens array<string>")


def rows(df):
    return sorted((r.query_id, r["rank"], r.ord, r.score) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(store, "RANGE", 8)
    monkeypatch.setattr(store, "FOLDERS", 4)
    monkeypatch.setattr(store, "ROUNDS", (2, 4))


def test_lifecycle_equals_a_rebuild(spark, tmp_path, small):
    docs = texts(300) + [(900, None), (901, [])]
    index = store.Index(spark, str(tmp_path / "index"))
    index.append(frame(spark, docs[:200]))
    index.append(frame(spark, docs[200:]))
    assert index.delete(spark.createDataFrame([(i,) for i in [*range(0, 300, 7), 901, 5000]], "x long")) == 44
    index.append(frame(spark, [(7, ["uva", "uva", "mel"]), (14, ["cha"])]))  # anew, with other words
    left = [d for d in docs if d[0] % 7 and d[0] != 901 or d[0] == 900] + [(7, ["uva", "uva", "mel"]), (14, ["cha"])]
    want = rows(rank.bm25(asked(spark), frame(spark, left), 5))
    for step in ("opened", "compacted"):
        again = store.Index(spark, str(tmp_path / "index"))
        assert again.n_docs == len(left) and again.documents().count() == len(left)
        ranked, report = store.search(asked(spark), again, 5)
        assert rows(ranked) == want, step
        index.compact()
    rebuilt = store.Index(spark, str(tmp_path / "rebuilt"))
    rebuilt.append(frame(spark, left))
    assert (rebuilt.n_docs, rebuilt.length) == (again.n_docs, again.length)


def test_skipping_changes_nothing_and_is_reported(spark, tmp_path, small):
    # The best documents stand together; elsewhere the words are rare and far between.
    docs = [(i, ["uva", "mel"] * 3 if 100 <= i < 110 else ["agua"] * 20 + ["uva"] * (i % 9 == 0) + ["mel"] * (i % 11 == 0)) for i in range(2000)]
    index = store.Index(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(docs, "ord long, tokens array<string>").coalesce(1))
    queries = spark.createDataFrame([(1, ["uva", "mel"])], "query_id long, tokens array<string>")
    ranked, report = store.search(queries, index, 5, pad=False)
    assert rows(ranked) == rows(rank.bm25(queries, spark.createDataFrame(docs, "ord long, tokens array<string>"), 5, pad=False))
    told = report.first()
    assert told.read < told.blocks / 10


def test_ties_go_by_ord_across_ranges(spark, tmp_path, small):
    index = store.Index(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame([(500 - i, ["uva"]) for i in range(400)], "ord long, tokens array<string>"))
    ranked, _ = store.search(spark.createDataFrame([(1, ["uva"])], "query_id long, tokens array<string>"), index, 3, pad=False)
    assert [r.ord for r in ranked.orderBy("rank").collect()] == [101, 102, 103]


def test_writes_that_clash_or_break_off(spark, tmp_path, small):
    path = str(tmp_path / "index")
    index = store.Index(spark, path)
    index.append(frame(spark, texts(20)))
    with pytest.raises(ValueError, match="already"):
        index.append(frame(spark, [(3, ["uva"])]))
    late = store.Index(spark, path)
    index.append(frame(spark, [(100, ["uva"])]))
    with pytest.raises(Exception):
        late.append(frame(spark, [(101, ["uva"])]))  # another writer was first
    # What the two left behind is in no commit.
    again = store.Index(spark, path)
    assert again.n_docs == 21 and {r.ord for r in again.documents().collect()} == {*range(20), 100}


def test_empty(spark, tmp_path, small):
    index = store.Index(spark, str(tmp_path / "index"))
    ranked, report = store.search(asked(spark), index, 5)
    assert ranked.count() == 0 and report.count() == 0
    index.append(frame(spark, []))
    assert store.search(asked(spark), index, 5)[0].count() == 0
    assert store.Index(spark, str(tmp_path / "index")).terms(asked(spark).select(F.explode("tokens").alias("term"))).count() == 0


def test_ranges_span_batches_and_null_tokens_drop_out(spark, tmp_path, small):
    docs = [*texts(60), (70, None), (71, []), (72, [None, "uva", None, "uva"]), (73, [None])]
    rows = spark.createDataFrame(docs, "ord long, tokens array<string>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        made = store._blocks_where_they_lie(rows)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        found = made.collect()
        index = store.Index(spark, str(tmp_path / "index"))
        index.append(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for at, (ord_, tokens) in enumerate(docs):
        for t in {*(tokens or [])} - {None}:
            want.setdefault((t, at // 8), []).append((ord_, tokens.count(t), len(tokens)))
    assert {(r.term, r.range): [tuple(h) for h in r.held] for r in found if r.term is not None} == want
    assert all((r.n, r.most_tf, r.least_dl) == (len(r.held), max(h.tf for h in r.held), min(h.dl for h in r.held)) for r in found if r.term is not None)
    assert sorted((h.ord, h.dl) for r in found if r.term is None for h in r.held) == [(o, len(t or [])) for o, t in docs]
    assert (index.n_docs, index.length) == (64, sum(len(t or []) for _, t in docs))


def test_a_search_reads_the_index_once(spark, tmp_path, small, monkeypatch):
    index = store.Index(spark, str(tmp_path / "index"))
    index.append(frame(spark, texts(300)))
    index.delete(spark.createDataFrame([(3,)], "x long"))
    reads, plain = [], store.Index.blocks
    monkeypatch.setattr(store.Index, "blocks", lambda self: reads.append(1) or plain(self))
    ranked, _ = store.search(asked(spark), index, 5)
    assert rows(ranked) == rows(rank.bm25(asked(spark), frame(spark, [t for t in texts(300) if t[0] != 3]), 5))
    assert len(reads) == 1
