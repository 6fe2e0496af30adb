"""Operator 1: toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed features of a document's distinct words (the
word, and its first four and six letters, which reach inflected and compounded forms).  Each model but the first also
sees the log-odds of the categories before it.  For training these come from FOLDS models that did not see the document
(out-of-fold predictions), so a later model learns how far it can trust an earlier one on unseen text.

The models are fitted on a bounded sample: of the labelled documents the TRAIN_ROWS with the least hash of doc_id, as far
as their features stay within TRAIN_FEATURES.  Everything else covers all documents and whole texts.  Scoring adds up
one weight per distinct word and category.

A null text has no words and gets the models' base odds.  A label that is null or absent keeps its document out of the
sample only; so do labels of one doc_id that contradict each other, while equal ones count once.  Of rows that share a
doc_id but not their text, the sample has the least text; all are scored.  With no labelled document of one kind a category's probability is the share seen (0 or 1; 0 without any
label).  Rows are scored independently: repeated rows get equal scores, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, arrow_map, table, written

TRAIN_ROWS = 6000
#: 80 MB at most on the driver.
TRAIN_FEATURES = 20_000_000
FOLDS = 4
BITS = 18
KEPT_WORDS = 400_000
#: Least chi-square statistic, of one degree of freedom, of a feature that a model may use.
TELLING = 30.0
#: Log-odds are cut at this size before a later model sees them.
CLIP = 8.0
EDGES = ".,;:!?\"'()[]{}|*#$%&<>_-"


def words_of(text: str | None) -> set[str]:
    """Distinct words without the signs around them; the signs, and how much the text repeats itself, as words too."""
    every = (text or "").lower().split()
    distinct = set(every)
    words = set()
    for w in distinct:
        core = w.strip(EDGES)
        words.add(core)
        if len(core) < len(w):
            words.add("\1" + w[w.rfind(core) + len(core) :] if core else "\1" + w)
    if every:
        words.add(f"\2{10 * len(distinct) // len(every)}")
    words -= {"", "\1"}
    return words


def features(word: str) -> tuple[int, int, int]:
    import xxhash

    mask = (1 << BITS) - 1
    return (
        xxhash.xxh3_64_intdigest(word) & mask,
        xxhash.xxh3_64_intdigest("4" + word[:4]) & mask,
        xxhash.xxh3_64_intdigest("6" + word[:6]) & mask,
    )


@dataclass
class Linear:
    """Log-odds = bias + sum of weights of features + sum of chain weights times earlier log-odds."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float


class Rows:
    """Sparse rows: feature numbers of row i are idx[ptr[i]:ptr[i + 1]], repeats allowed."""

    def __init__(self, lists):
        self.ptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.idx = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)

    def pairs(self):
        """Distinct (feature, row), as two arrays."""
        row = np.repeat(np.arange(len(self)), np.diff(self.ptr))
        found = np.unique(self.idx * max(1, len(self)) + row)
        return found // max(1, len(self)), found % max(1, len(self))

    def only(self, keep: np.ndarray):
        """Without the features that keep rules out."""
        row = np.repeat(np.arange(len(self)), np.diff(self.ptr))
        stays = keep[self.idx]
        return Rows(np.split(self.idx[stays], np.cumsum(np.bincount(row[stays], minlength=len(self)))[:-1]))

    def take(self, rows):
        return Rows([self.idx[self.ptr[i] : self.ptr[i + 1]] for i in rows])

    def __len__(self):
        return len(self.ptr) - 1

    def dot(self, w):
        total = np.concatenate([[0.0], np.cumsum(w[self.idx])])
        return total[self.ptr[1:]] - total[self.ptr[:-1]]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """Which features stand in rows of one kind far more often than chance would have it."""
    feature, row = x.pairs()
    n, yes = len(y), y.sum()
    with_it = np.bincount(feature, minlength=1 << BITS).astype(float)
    both = np.bincount(feature, y[row], 1 << BITS)
    spread = with_it * (n - with_it) * yes * (n - yes)
    return n * (n * both - with_it * yes) ** 2 >= TELLING * np.maximum(spread, 1)


def fit(x: Rows, earlier: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.3, ridge: float = 1e-6) -> Linear:
    """Logistic regression by AdaGrad over mini-batches in a fixed order; the same rows give the same model."""
    share = float(y.mean()) if len(y) else 0.0
    m = Linear(np.zeros(1 << BITS), np.zeros(earlier.shape[1]), 0.0)
    if share in (0.0, 1.0):
        m.bias = 30.0 if share else -30.0
        return m
    m.bias = float(np.log(share / (1 - share)))
    x = x.only(telling(x, y))
    g2, c2, b2 = np.full(1 << BITS, 1e-4), np.full(earlier.shape[1], 1e-4), 1e-4
    order = np.random.default_rng(1)
    for _ in range(epochs):
        rows = order.permutation(len(y))
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            own = x.take(part)
            error = (_sigmoid(own.dot(m.weights) + earlier[part] @ m.chain + m.bias) - y[part]) / len(part)
            spread = np.repeat(error, np.diff(own.ptr))
            seen, back = np.unique(own.idx, return_inverse=True)
            grad = np.bincount(back, spread, len(seen)) + ridge * m.weights[seen]
            g2[seen] += grad**2
            m.weights[seen] -= rate * grad / np.sqrt(g2[seen])
            grad = earlier[part].T @ error
            c2 += grad**2
            m.chain -= rate * grad / np.sqrt(c2)
            b2 += error.sum() ** 2
            m.bias -= rate * error.sum() / np.sqrt(b2)
    return m


def _log_odds(m: Linear, x: Rows, earlier: np.ndarray) -> np.ndarray:
    return np.clip(x.dot(m.weights) + earlier @ m.chain + m.bias, -CLIP, CLIP)


def fit_chain(x: Rows, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model per column of labels; later ones see out-of-fold log-odds of the earlier ones."""
    fold = np.arange(len(x)) % folds
    earlier, chain = np.zeros((len(x), 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(fit(x, earlier, y))
        if c + 1 == labels.shape[1]:
            break
        out = np.zeros(len(x))
        for f in range(folds):
            held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(held) and len(rest):
                m = fit(x.take(rest), earlier[rest], y[rest])
                out[held] = _log_odds(m, x.take(held), earlier[held])
        earlier = np.column_stack([earlier, out])
    return chain


def training_sample(docs: DataFrame, labelled: DataFrame, categories: dict[str, Column], limit: int, doc: str, text: str, most: int = TRAIN_FEATURES):
    """Rows and labels of the bounded sample."""
    named = labelled.select(F.col(doc).alias("_id"), *(v.cast("int").alias(k) for k, v in categories.items()))
    clear = named.groupBy("_id").agg(*(F.min(k).alias(k) for k in categories), *(F.max(k).alias(f"_max_{k}") for k in categories))
    for k in categories:
        clear = clear.where(F.col(k) == F.col(f"_max_{k}"))
    few = clear.where(F.col("_id").isNotNull()).select("_id", *categories).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(doc), F.col(text).cast("string").alias("_text")).join(F.broadcast(few), F.col(doc) == F.col("_id"))

    def run(ids, texts, *labels):
        made = [[f for w in sorted(words_of(t)) for f in features(w)] for t in texts]
        return [ids, [np.array(x, "<i4").tobytes() for x in made], *labels]

    schema = "id long, f binary, " + ", ".join(f"{k} int" for k in categories)
    # A document that stands in the table many times is one training row.
    once = rows.groupBy("_id").agg(F.min("_text").alias("_text"), *(F.first(k).alias(k) for k in categories))
    made = written(arrow_map(once, run, schema, rows=128), "sample")
    total, last = 0, None
    sizes = made.select("id", F.xxhash64("id").alias("h"), (F.octet_length("f") / 4).cast("long").alias("n"))
    for r in sizes.orderBy("h", "id").collect():
        total += r.n
        if total > most:
            break
        last = r
    if last is None:
        got = []
    else:
        within = F.struct(F.xxhash64("id"), "id") <= F.struct(F.lit(last.h).cast("long"), F.lit(last.id).cast("long"))
        got = made.where(within).orderBy(F.xxhash64("id"), "id").collect()
    x = Rows([np.frombuffer(r.f, "<i4") for r in got])
    return x, np.array([[r[k] for k in categories] for r in got], np.int64).reshape(len(got), len(categories))


def plain(chain: list[Linear]) -> list[tuple]:
    """The chain without classes of this package, which workers may lack."""
    return [(m.weights, m.chain, m.bias) for m in chain]


class Scorer:
    """Sums of weights of distinct words; a word's own sum is kept."""

    def __init__(self, chain: list[tuple]):
        """chain: as plain() gives it."""
        self.chain = chain = [Linear(*m) for m in chain]
        self.weights = np.stack([m.weights for m in chain], 1)
        self.kept: dict[str, int] = {}
        self.sums = np.zeros((1024, len(chain)))

    def _learn(self, new: list[str]) -> None:
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
        at, end = len(self.kept), len(self.kept) + len(new)
        if end > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(end, len(self.sums)), self.sums.shape[1]))])
        f = np.array([features(w) for w in new])
        self.sums[at:end] = self.weights[f].sum(1)
        self.kept.update(zip(new, range(at, end)))

    def probabilities(self, text: str | None) -> list[float]:
        words = words_of(text)
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            new = list(words)
        if new:
            self._learn(new)
        total = self.sums[np.sort(np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words)))].sum(0)
        odds: list[float] = []
        for c, m in enumerate(self.chain):
            odds.append(float(np.clip(total[c] + m.bias + np.dot(m.chain, odds), -CLIP if c + 1 < len(self.chain) else -30, CLIP if c + 1 < len(self.chain) else 30)))
        return [float(_sigmoid(o)) for o in odds]


def scored(df: DataFrame, chain: list[Linear], names: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and p_<category> for every row of df."""
    sent = Sent(df.sparkSession, "toxicity", plain(chain))

    def run(ids, texts):
        s = sent.made(Scorer)
        return [ids, *(list(map(list, zip(*(s.probabilities(t) for t in texts)))) or [[] for _ in names])]

    kind = df.schema[doc].dataType.simpleString()
    schema = f"{doc} {kind}, " + ", ".join(f"p_{n} double" for n in names)
    return arrow_map(df.select(doc, F.col(text).cast("string")), run, schema)


#: The labels table knows two traits; the chain ends with their conjunction, which earlier links help most.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 AND quality = 0",
}


def op1_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = {k: F.expr(v) for k, v in CATEGORIES.items()}
    x, y = training_sample(docs, labels, categories, TRAIN_ROWS, "doc_id", "text")
    out = scored(docs, fit_chain(x, y), list(categories))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
