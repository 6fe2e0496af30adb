"""The pipeline against plain Python, stage by stage, and its contract."""

import re
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from matchloom.llm import packing, pii, quality
from tests.llm import docs, test_linededup, test_neardup, test_packing, test_quality
from tokenizers import Tokenizer

DRIVER_TABLES = Path("/root/testdata/sf0.001")


def kept_by_rules(text):
    n, chars, symbols, dup, repeat = test_quality.brute(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    lines = [x for x in text.split("\n") if test_quality.WORD.search(x)]
    measures = {
        "n_words": n,
        "mean_word_chars": chars / n,
        "symbol_ratio": symbols / n,
        "stop_ratio": sum(w.lower() in quality.STOP_WORDS for w in test_quality.WORD.findall(text)) / n,
        "dup_line_ratio": dup / len(lines),
        "bullet_line_ratio": sum(bool(re.match(r"\s*[-*•]", x)) for x in lines) / len(lines),
        "ellipsis_line_ratio": sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines) / len(lines),
    }
    return all((r.low is None or measures[r.measure] >= r.low) and (r.high is None or measures[r.measure] <= r.high) for r in quality.RULES)


def brute(data):
    data = [(d, t) for d, t in data if kept_by_rules(t or "")]
    data = [(d, t) for d, _, _, t in test_linededup.brute(data)]
    root = test_neardup.brute(data, 5)
    return [(d, pii.redacted_text(t)) for d, t in data if root[d] == d]


def check(spark, sf_dir, data):
    want = brute(data)
    assert want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check(rows, want, tokenizer, packing.Limits(), True)


def test_order_and_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_small_documents(spark, tmp_path):
    rows = docs.rows()
    docs.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [(d, t) for d, t, *_ in rows])


def test_driver_documents(spark):
    if DRIVER_TABLES.exists():
        rows = spark.read.parquet(f"{DRIVER_TABLES}/documents.parquet").select("doc_id", "text").collect()
        check(spark, str(DRIVER_TABLES), [tuple(r) for r in rows])


def test_stages_bear_empty_documents(spark):
    df = docs.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_bear_clashing_names(spark):
    """Columns named as the stages' own, in any case; they come through, and the result is that without them."""
    names = ["row", "kept", "drop", "_drop", "_q_text", "_n_lines", "bands", "rep", "gone_id", "_Of_Id", "key", "turn", "group", "ids", "length", "base_failed", "n_words"]
    plain = docs.frame(spark)
    odd = plain.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, ""), stage(spark, odd, "")
        if name == "packing":
            columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        else:
            assert b.columns == odd.columns
            assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in b.collect())
            columns = plain.columns
        assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect())), name
        plain, odd = a.select(*columns) if name == "packing" else a, b


def test_tables_on_the_way_go(spark, tmp_path):
    from matchloom.sources import shared

    docs.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    before = list(shared._TABLES)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p for p in shared._TABLES if p not in before]
    assert len(left) == 1 and out.count() > 0
    shared.remove(spark, left)
    assert not Path(left[0]).exists() and shared._TABLES == before


def test_a_run_leaves_other_threads_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from matchloom.sources import shared

    with shared.own_tables() as own:
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(shared.new_path, spark, "other").result()
        with shared.own_tables() as inner:
            path = shared.new_path(spark, "mine")
        assert inner == own == [path] and other in shared._TABLES
    shared.remove(spark, [path, other])
