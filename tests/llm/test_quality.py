import re
from collections import Counter

from matchloom.llm import quality as Q
from tests.llm import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + o for i, g in enumerate(grams) if g in twice for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    got = Q.judged(docs.frame(spark).select("doc_id", "text", "lang")).collect()
    assert len(got) == len(docs.rows())
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_stage_keeps_columns_and_rules(spark):
    df = docs.frame(spark)
    want = {r.doc_id for r in Q.judged(df).where("kept").collect()}
    out = Q.stage(spark, df, "")
    assert out.schema == df.schema
    assert {r.doc_id for r in out.collect()} == want


def test_clashing_columns_and_empty(spark):
    df = docs.frame(spark).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    assert Q.judged(df).where("n_words >= 0").count() == len(docs.rows())
    assert Q.judged(docs.empty(spark)).count() == 0


def test_rules_compile(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "m double")
    assert df.where(Q.compiled((Q.Rule("m", 1.0, 2.0),))).count() == 1


def test_stage_bears_any_names(spark):
    from matchloom.llm import linededup, neardup

    df = docs.frame(spark).withColumnRenamed("lang", "_q_words").withColumnRenamed("source", "n_words")
    assert {r["_q_words"] for r in Q.stage(spark, df, "").collect()} == {"en"}
    df = df.withColumnRenamed("_q_words", "_n_lines").withColumnRenamed("n_words", "_kept")
    out = linededup.stage(spark, df, "")
    assert out.columns == df.columns and {r["_n_lines"] for r in out.collect()} == {"en"}
    df = df.withColumnRenamed("_n_lines", "_of_id")
    assert neardup.stage(spark, df, "").columns == df.columns
