import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from matchloom.llm import lexical
from pyspark.sql import functions as F
from tests.llm import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, items, k):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in data]
    n_docs, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    out = []
    for i, text in items:
        scored = []
        weights = {}
        for t in set(TERM.findall((text or "").translate(LOWER))):
            df = sum(t in c for _, c in held)
            if df:
                weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for d, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs // length if length else 0)
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def asked():
    rng = random.Random(4)
    pool = [t for t in docs.texts() if t]
    some = [" ".join(rng.sample((rng.choice(pool) + " " + rng.choice(pool)).split(), 2)) for _ in range(20)]
    return [(i, t) for i, t in enumerate(some)] + [(100, None), (101, ""), (102, "nowhere-at-all"), (3, some[4]), (None, some[5]), (103, pool[0] * 3), (103, pool[0] * 3), (104, "the THE The"), (105, "日本語 Ünï ünï")]


def run(spark, data, items, k=50):
    rows = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = lexical.search(rows, spark.createDataFrame(items, "item_id long, text string").repartition(2), k)[0].collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr)


def texts():
    data = [(d, t) for d, t, *_ in docs.rows()]
    return data + [(None, data[0][1]), (5000, "日本語 Ünï ÜNÏ"), (5001, "x\x00y\x7fz"), (5002, data[0][1]), (5003, "the " * 70)]


def test_matches_brute_force(spark):
    assert run(spark, texts(), asked()) == brute(texts(), asked(), 50)


@pytest.mark.parametrize("small", [{"SAMPLE": 20, "SHARD": 16}, {"POSTINGS": 40, "BLOCK_PAIRS": 30}, {"VOCABULARY": 10, "AT_ONCE": 1, "SAMPLE": 30}])
def test_small_shards_blocks_and_vocabulary(spark, monkeypatch, small):
    for name, n in small.items():
        monkeypatch.setattr(lexical, name, n)
    assert run(spark, texts(), asked(), 4) == brute(texts(), asked(), 4)


def test_copies_tie_by_id(spark):
    data = [(1000 - i, "one and the same text") for i in range(300)] + [(i, f"text {i}") for i in range(300)]
    got = run(spark, data, [(1, "same text")], 5)
    assert got == brute(data, [(1, "same text")], 5) and [r[2] for r in got] == [701, 702, 703, 704, 705]


def test_search_opens_few_ranges():
    rng = np.random.default_rng(0)
    docs_n, terms_n = 4096, 40
    held = rng.random((terms_n, docs_n)) < 0.05
    held[:, 100:130] = rng.random((terms_n, 30)) < 0.9
    term, doc = np.nonzero(held)
    share = rng.integers(1, 300_000, len(term))
    near = np.isin(doc, np.arange(100, 130))
    share[near] += 700_000
    trees = lexical.Trees(term, doc, share, docs_n)
    terms, weights = np.arange(terms_n), rng.integers(1, 9000, terms_n)
    full = np.zeros(docs_n, np.int64)
    np.add.at(full, doc, weights[term] * share)
    found, scores, opened = trees.best(terms, weights, 5, 1)
    assert (full[found] == scores).all() and set(np.argsort(-full, kind="stable")[:5]) <= set(found.tolist())
    assert opened < docs_n / lexical.FAN / 4
    again, _, fewer = trees.best(terms, weights, 5, int(np.sort(full)[-5]))
    assert set(again.tolist()) >= set(np.argsort(-full, kind="stable")[:5].tolist()) and fewer <= opened


def test_long_lengths_do_not_overflow():
    assert lexical.shares(np.array([3]), np.array([10**9]), 10**10, 10**12).tolist() == [1_000_000_000 * 3 // (3000 + 20 * (50 + 50 * 10**19 // 10**12))]


def test_none_and_clashing_names(spark):
    assert run(spark, [], asked()) == [] and run(spark, texts(), []) == [] and run(spark, [(1, None)], asked()) == []
    rows = spark.createDataFrame(texts(), "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("n"), F.lit(3).alias("ids"), F.lit(4).alias("score"))
    items = spark.createDataFrame(asked(), "item_id long, text string").select("*", F.lit(1).alias("item"), F.lit(1).alias("terms"), F.lit(1).alias("doc_id"))
    out, opened = lexical.search(rows, items, 3)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == len(brute(texts(), asked(), 3))
    assert opened.agg(F.sum("opened")).first()[0] > 0
