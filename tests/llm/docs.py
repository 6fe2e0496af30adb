"""Small documents with the cases that every operator must bear."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

SYLLABLES = ["an", "the", "or", "ing", "er", "st", "ou", "ä", "é", "tion", "nd", "ly"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def texts(seed=1):
    rng = random.Random(seed)
    plain = ["\n".join(" ".join(sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    common = "This line stands in many documents, " + sentence(rng, 8)
    plain += [p + "\n" + common.upper() + "  " for p in plain[:9]]
    base = sentence(rng, 120)
    near = []
    for i in range(14):
        w = base.split(" ")
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "odd%d" % rng.randrange(1000)
        near.append(" ".join(w))
    passage = " ".join(sentence(rng, 9) for _ in range(7))
    quoted = [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(4)]
    odd = [None, "", " ", "\n", "\n\n\n", "one", "One  two\tthree", "a b c", "A B C", "x" * 3000, "word " * 2500, "no end " + "é" * 500, "  ", "tab\tand\x0bfeed\x0c end\r\n"]
    copies = [plain[0]] * 4 + [plain[1].upper(), base, base]
    private = ["Write to jane.doe@mail.example.org or call +1 (555) 123-4567 now.", "name [at] host [dot] org and 192.168.1.77 and 4111 1111 1111 1111"]
    return plain + near + quoted + odd + copies + private


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i * 3 + 1, t, "en", "src%d" % (i % 3), len(t or "")) for i, t in enumerate(texts(seed))]
    out.append(out[5])  # a repeated row
    rng.shuffle(out)
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
