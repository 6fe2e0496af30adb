import math
import random
from collections import Counter

import numpy as np
from matchloom.functions import text as T
from matchloom.operators import analysis, cells, embed, metrics, rank
from pyspark.sql import functions as F

DOCS = ["suco uva 1l", "suco laranja 1l", "suco uva integral 1l", "agua sem gas 500ml", "", "suco uva 1l", "refrigerante laranja 2l"]
ASKED = ["suco uva 1l", "laranja", "laranja laranja 2l", "nada disso", ""]


def frames(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "ord long, doc string")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, doc string")
    split = F.filter(F.split("doc", " "), lambda x: x != "")
    return docs.withColumn("tokens", split), asked.withColumn("tokens", split)


def bm25_plain(query, docs, k1=1.5, b=0.75):
    bags = [Counter(d.split()) for d in docs]
    n, avg = len(docs), sum(sum(x.values()) for x in bags) / len(docs)
    out = []
    for bag in bags:
        s = 0.0
        for t in query.split():
            df = sum(t in x for x in bags)
            if bag[t]:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * sum(bag.values()) / avg))
        out.append(round(s, 6))
    return out


def tfidf_plain(query, docs, terms):
    bags = [Counter(terms(d)) for d in docs]
    n = len(docs)
    df = Counter(t for x in bags for t in x)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}

    def unit(bag):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in bag.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    q = unit(Counter(terms(query)))
    return [round(sum(x * d.get(t, 0) for t, x in q.items()), 6) for d in map(unit, bags)]


def best(scores, k):
    return sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k]


def check(ranked, plain, k):
    rows = {}
    for r in ranked.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.ord, r.score))
    for i, q in enumerate(ASKED):
        scores = plain(q)
        got = sorted(rows[i])
        assert [o for _, o, _ in got] == best(scores, k)
        assert all(abs(s - scores[o]) < 2e-6 for _, o, s in got)
        assert all(x[2] >= y[2] for x, y in zip(got, got[1:]))


def test_bm25(spark):
    docs, asked = frames(spark)
    check(rank.bm25(asked, docs, 4, pad=True), lambda q: bm25_plain(q, DOCS), 4)
    found = {r.query_id for r in rank.bm25(asked, docs, 4, pad=False).collect()}
    assert found == {0, 1, 2}


def test_tfidf_words_and_duplicates(spark):
    docs, asked = frames(spark)
    terms_of = lambda c: T.with_bigrams(T.word_terms(c))

    def terms(t):
        w = [x for x in t.split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    check(rank.tfidf(asked, docs, terms_of, 3, pad=True), lambda q: tfidf_plain(q, DOCS, terms), 3)


def test_tfidf_characters(spark):
    from tests.test_text import char_wb_plain

    docs, asked = frames(spark)
    check(rank.tfidf(asked, docs, T.char_wb, 3, pad=True), lambda q: tfidf_plain(q, DOCS, lambda t: char_wb_plain(t, 3, 5)), 3)


def test_partitions_do_not_matter(spark):
    docs, asked = frames(spark)
    one = sorted(map(tuple, rank.bm25(asked, docs, 5).collect()))
    assert sorted(map(tuple, rank.bm25(asked.repartition(5), docs.repartition(7), 5).collect())) == one


def test_dense_and_hybrid(spark):
    docs, asked = frames(spark)
    rng = random.Random(1)
    vectors = [[rng.random() for _ in range(4)] for _ in DOCS]
    v = spark.createDataFrame(list(enumerate(vectors)), "ord long, embedding array<float>")
    catalogue = embed.from_column(docs.join(v, "ord"))
    q = embed.from_column(asked.join(v.withColumnRenamed("ord", "query_id"), "query_id"), out="q")
    dense = rank.dense(q.select("query_id", "q"), catalogue.select("ord", "v"), 1).collect()
    assert {r.query_id: r.ord for r in dense} == {i: i for i in range(len(ASKED))}
    got = rank.hybrid(q, catalogue, 2, candidates=3).collect()
    assert len(got) == 2 * len(ASKED) and all(r.bm25_rank <= 3 for r in got)


def ranks(spark, hits):
    rows, gold, q = [], [], 0
    for position, count in hits.items():
        for _ in range(count):
            rows += [(q, r, 1000 if r == position else r, 1.0 / r) for r in range(1, 6)]
            gold.append((q, 1000))
            q += 1
    return spark.createDataFrame(rows, "query_id long, rank long, ord long, score double"), spark.createDataFrame(gold, "query_id long, gold long")


def test_published_measures(spark):
    for hits, want in (({1: 248, 2: 2}, (0.992, 0.996, 1.0)), ({1: 236, 2: 7, 3: 2, 4: 1, 0: 4}, (0.944, 0.962, 0.984))):
        got = metrics.metrics(*ranks(spark, hits)).first()
        assert (round(got.p1, 3), round(got.mrr, 3), round(got.recall, 3), got.n) == (*want, 250)
        assert got.p1 <= got.mrr <= got.recall


def test_no_queries(spark):
    ranked, gold = ranks(spark, {1: 1})
    got = metrics.metrics(ranked, gold.limit(0)).first()
    assert got.n == 0 and got.p1 is None


PUBLISHED = [
    ("Fralda pampers confort sec g 128 unidades", "Fralda pampers confort sec g 60 unidades", "variante"),
    ("Espumante brut branco arte tradicional casa valduga 750ml", "Espumante brut rosé arte tradicional casa valduga 750ml", "variante"),
    ("Pipoca para micro-ondas manteiga yoki 100g", "Saco hermético para freezer e microondas 31x27cm conserv 8 unidades", "produto"),
    ("Biscoito recheado chocolate chocolícia 132g", "Biscoito recheado tortinha de limão trakinas 126g", "tamanho"),
    ("Queijo tipo maasdam président 160g", "Queijo mussarela fatiado président 150g", "tamanho"),
    ("Aperitivo francês lillet blanc 750ml", "Bergerac francês vinho tinto 750ml", "variante"),
    ("Salsicha viena ceratti 200g", "Salsicha viena perdigão 500g", "tamanho"),
    ("Sal grosso para churrasco cisne 1kg", "Sal grosso para churrasco iodado lebre 1kg", "variante"),
]


def test_published_diagnoses(spark):
    df = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(PUBLISHED)], "i int, gold_name string, top_name string")
    got = {r.i: r.diagnosis for r in analysis.diagnosed(df).collect()}
    assert all(got[i].startswith(w) for i, (_, _, w) in enumerate(PUBLISHED))


def test_embeddings_of_a_model(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abc",)], "doc string")
    got = embed.from_model(df, lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()
    assert [list(r.v) for r in got] == [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_dense_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.6, 0.8]) for _ in range(5)]) for i in range(60)] + [(60, None)]
    v = spark.createDataFrame(rows, "ord long, v array<float>").repartition(3)
    q = v.selectExpr("ord AS query_id", "v AS q")
    whole = sorted(map(tuple, rank.dense(q, v, 4).collect()))
    monkeypatch.setattr(cells, "QUERY_BLOCK", 7)
    monkeypatch.setattr(cells, "VECTOR_BLOCK", 9)
    monkeypatch.setattr(cells, "CELLS", 4)
    assert sorted(map(tuple, rank.dense(q, v, 4).collect())) == whole
    want = []
    for i, a in rows[:60]:
        scored = sorted((-round(sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b)), 6), j) for j, b in rows[:60])[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert whole == sorted(want)


def test_dense_leaves_far_cells_out(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 2000)] + 0.02 * rng.normal(size=(2000, 16))
    v /= np.sqrt((v**2).sum(1))[:, None]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    docs = spark.createDataFrame(rows + [(9000, None), (9001, [1.0])], "ord long, v array<float>").repartition(4)
    asked = spark.createDataFrame(rows[:50] + [(9000, None), (9001, [1.0])], "query_id long, q array<float>")
    got = sorted((r.query_id, r["rank"], r.ord) for r in rank.dense(asked, docs, 5).collect())
    f = v.astype(np.float32).astype(float)
    scores = np.round(f[:50] @ f.T, 6)
    assert got == sorted((i, n + 1, int(j)) for i in range(50) for n, j in enumerate(np.lexsort((np.arange(2000), -scores[i]))[:5]))
    compared = [r.compared for r in cells.search(asked, docs, 5)[1].collect()]
    assert len(compared) == 50 and sum(compared) < 50 * 2000 / 4
    assert rank.dense(asked, docs.limit(0), 5).count() == 0 and rank.dense(asked.limit(0), docs, 5).count() == 0


def test_hashed_vectors(spark):
    from hashlib import md5

    texts = ["suco uva 1l", "suco uva 1l", "uva", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, doc string").repartition(3)
    got = {r.ord: r.v for r in embed.hashed(df, "ord", F.split(F.nullif("doc", F.lit("")), " "), size=16).collect()}
    assert set(got) == set(range(5))
    for i, t in enumerate(texts):
        v = np.zeros(16)
        for w in (t or "").split():
            h = int(md5(w.encode()).hexdigest()[:4], 16)
            v[h % 16] += 1 - 2 * (h // 16 % 2)
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_error_sets_by_text(spark):
    rows = [(1, "a", True), (2, "a", False), (3, "b", True), (4, "c", False), (5, None, False)]
    one = spark.createDataFrame(rows, "query_id long, text string, correct boolean")
    two = one.withColumn("correct", F.col("text") != "b").na.fill(True)
    assert {tuple(r) for r in analysis.error_sets(one, two, "text").where("text IS NOT NULL").collect()} == {("a", "only_one"), ("b", "only_two"), ("c", "only_one")}
    assert {tuple(r) for r in analysis.error_sets(one, two).collect()} == {(2, "only_one"), (3, "only_two"), (4, "only_one"), (5, "only_one")}
