from collections import defaultdict

from matchloom.llm import linededup as L
from tests.llm import docs

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, least=40, many=5):
    where = defaultdict(set)
    cut = [(d, (t or "").split("\n")) for d, t in data]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, lines in cut:
        for line in lines:
            if d is not None and len(key(line)) >= least:
                where[key(line)].add(d)
    hot = {k: max(v) for k, v in where.items() if len(v) >= many}
    out = []
    for d, lines in cut:
        left = [x for x in lines if d is None or not (key(x) in hot and d < hot[key(x)])]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(((r.doc_id, r._n_lines, r._n_dropped, r.text) for r in L.deduplicated(df, **how).collect()), key=str)


def test_matches_brute_force(spark):
    data = [(d, t) for d, t, *_ in docs.rows()]
    assert got(docs.frame(spark)) == brute(data)
    assert got(docs.frame(spark), min_chars=1, min_docs=2) == brute(data, 1, 2)
    assert any(r[2] for r in brute(data))


def test_hot_line_nulls_and_repeats(spark):
    line = "Ä common line that is long enough to count for sure"
    data = [(i, f"{line}\nown {i}\n  {line.replace('common', 'COMMON')}") for i in range(60)] + [(None, line), (3, line)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(df) == brute(data)


def test_clashing_columns_and_empty(spark):
    df = docs.frame(spark).withColumnRenamed("lang", "digest").withColumnRenamed("source", "doc")
    assert L.deduplicated(df).where("digest = 'en'").count() == len(docs.rows())
    assert L.deduplicated(docs.empty(spark)).count() == 0
    out = L.stage(spark, docs.frame(spark), "")
    assert out.schema.names == docs.SCHEMA.names
    assert all(r.n_chars == len(r.text) for r in out.collect())
