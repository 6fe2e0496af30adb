import random

import numpy as np
from matchloom.llm import toxicity as X
from pyspark.sql import functions as F
from tests.llm import docs

BAD = ["grumble", "blathering", "nincompoop"]


def labelled(n=400, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(docs.SYLLABLES) + rng.choice(docs.SYLLABLES) + rng.choice(docs.SYLLABLES) for _ in range(30)]
        toxic, rude = i % 5 == 0, i % 10 == 0
        if toxic:
            words[3] = words[9] = rng.choice(BAD) + rng.choice(["", "s", "ing"])
        if rude:
            words[5] = "boorish"
        rows.append((i, " ".join(words) + ".", int(toxic), int(rude)))
    return rows


def frames(spark):
    rows = labelled()
    text = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 300], "doc_id long, toxic int, rude int")
    return rows, text, labels


def test_held_out_accuracy_of_the_chain(spark):
    rows, text, labels = frames(spark)
    categories = {"toxic": F.col("toxic"), "rude": F.col("rude")}
    x, y = X.training_sample(text, labels, categories, 1000, "doc_id", "text")
    assert y.shape == (300, 2)
    chain = X.fit_chain(x, y)
    assert len(chain[1].chain) == 1 and chain[0].chain.size == 0
    got = {r.doc_id: r for r in X.scored(text, chain, list(categories)).collect()}
    held = [r for r in rows if r[0] >= 300]
    assert np.mean([(got[i].p_toxic >= 0.5) == bool(t) for i, _, t, _ in held]) >= 0.95
    assert np.mean([(got[i].p_rude >= 0.5) == bool(t) for i, _, _, t in held]) >= 0.95


def test_scorer_equals_plain_sums(spark):
    rows, text, labels = frames(spark)
    x, y = X.training_sample(text, labels, {"toxic": F.col("toxic"), "rude": F.col("rude")}, 100, "doc_id", "text")
    assert len(x) == 100
    chain = X.fit_chain(x, y)
    for _, t, *_ in rows[:30]:
        f = [i for w in X.words_of(t) for i in X.features(w)]
        odds = [sum(chain[0].weights[f]) + chain[0].bias]
        odds.append(sum(chain[1].weights[f]) + chain[1].bias + chain[1].chain[0] * np.clip(odds[0], -X.CLIP, X.CLIP))
        assert np.allclose(X.Scorer(X.plain(chain)).probabilities(t), [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds], atol=1e-3)


def test_later_models_see_out_of_fold_odds(spark):
    _, text, labels = frames(spark)
    categories = {"toxic": F.col("toxic"), "rude": F.col("rude"), "both": F.expr("toxic * rude")}
    x, y = X.training_sample(text, labels, categories, 120, "doc_id", "text")
    chain = X.fit_chain(x, y, folds=3)
    earlier = []
    for c in range(3):
        seen = np.array(earlier).T.reshape(len(x), c)
        whole = X.fit(x, seen, y[:, c].astype(float))
        assert np.allclose(whole.weights, chain[c].weights) and np.allclose(whole.chain, chain[c].chain) and np.isclose(whole.bias, chain[c].bias)
        odds = []
        for i in range(len(x)):
            others = [j for j in range(len(x)) if j % 3 != i % 3]
            if i < 3:
                fold_models = fold_models if i else {}
                fold_models[i] = X.fit(x.take(others), seen[others], y[others, c].astype(float))
            m = fold_models[i % 3]
            own = x.idx[x.ptr[i] : x.ptr[i + 1]]
            odds.append(np.clip(m.weights[own].sum() + seen[i] @ m.chain + m.bias, -X.CLIP, X.CLIP))
        earlier.append(odds)


def test_contradicting_and_repeated_labels_and_the_feature_bound(spark):
    docs_ = spark.createDataFrame([(1, "b one"), (1, "a one"), (2, "two"), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (3, None)], "doc_id long, toxic int")
    x, y = X.training_sample(docs_, labels, {"toxic": F.col("toxic")}, 10, "doc_id", "text")
    assert sorted(y[:, 0].tolist()) == [0, 1]
    rows = {tuple(sorted(x.idx[x.ptr[i] : x.ptr[i + 1]].tolist())) for i in range(len(x))}
    assert rows == {tuple(sorted(f for w in X.words_of(t) for f in X.features(w))) for t in ("a one", "three")}
    x, _ = X.training_sample(docs_, labels, {"toxic": F.col("toxic")}, 10, "doc_id", "text", most=len(next(iter(rows))))
    assert len(x) <= 1
    x, _ = X.training_sample(docs_, labels, {"toxic": F.col("toxic")}, 10, "doc_id", "text", most=1)
    assert len(x) == 0


def test_one_kind_nulls_and_empty(spark):
    text = docs.frame(spark)
    labels = spark.createDataFrame([(1, 0), (4, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    x, y = X.training_sample(text, labels, {"toxic": F.col("toxic")}, 10, "doc_id", "text")
    assert len(x) == 2
    scored = X.scored(text, X.fit_chain(x, y), ["toxic"])
    assert scored.count() == len(docs.rows()) and scored.where("p_toxic > 0.01").count() == 0
    x, y = X.training_sample(docs.empty(spark), labels, {"toxic": F.col("toxic")}, 10, "doc_id", "text")
    assert len(x) == 0
    assert X.scored(docs.empty(spark), X.fit_chain(x, y), ["toxic"]).count() == 0
    assert X.scored(text, X.fit_chain(x, y), ["toxic"]).where("p_toxic > 0.01").count() == 0


def test_word_table_overflow(monkeypatch):
    monkeypatch.setattr(X, "KEPT_WORDS", 10)
    chain = [X.Linear(np.arange(1 << X.BITS) / 1e7, np.zeros(0), 0.0)]
    s = X.Scorer(X.plain(chain))
    once = [X.Scorer(X.plain(chain)).probabilities(t) for t in docs.texts()]
    assert np.allclose([s.probabilities(t) for t in docs.texts()], once)
