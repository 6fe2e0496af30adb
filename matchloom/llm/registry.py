"""Queries of the training-data operators and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from matchloom.llm import balls, lexical, linededup, neardup, topk
from matchloom.llm.balls import op13_ball_tree_clusters
from matchloom.llm.bpe import op12_bpe_segment_tree
from matchloom.llm.lexical import op11_max_tree_search
from matchloom.llm.linededup import op10_line_dedup
from matchloom.llm.neardup import op9_minhash_neardup
from matchloom.llm.packing import op7_packing
from matchloom.llm.pieces import op4_sentencepiece
from matchloom.llm.pii import op2_pii
from matchloom.llm.quality import RULES, STOP_WORDS, op5_quality_rules
from matchloom.llm.sharding import op8_sharding
from matchloom.llm.substring import op6_substring_dedup
from matchloom.llm.toxicity import op1_toxicity_chain
from matchloom.llm.topk import op3_pivot_topk


def queries():
    return {
        "op1_toxicity_chain": op1_toxicity_chain,
        "op2_pii": op2_pii,
        "op3_pivot_topk": op3_pivot_topk,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op10_line_dedup": op10_line_dedup,
        "op11_max_tree_search": op11_max_tree_search,
        "op12_bpe_segment_tree": op12_bpe_segment_tree,
        "op13_ball_tree_clusters": op13_ball_tree_clusters,
    }


def _op5_sql() -> str:
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars::double / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols::double / n_words ELSE 0 END",
        "stop_ratio": "CASE WHEN n_words > 0 THEN n_stop::double / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines::double / n_lines ELSE 0 END",
        "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullets::double / n_lines ELSE 0 END",
        "ellipsis_line_ratio": "CASE WHEN n_lines > 0 THEN n_ellipses::double / n_lines ELSE 0 END",
    }
    rules = [f"{ratio[r.measure]} >= {r.low}::double" for r in RULES if r.low is not None]
    rules += [f"{ratio[r.measure]} <= {r.high}::double" for r in RULES if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
       n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept
FROM b
"""


def oracle_sql():
    return {
        "op3_pivot_topk": topk.SQL,
        "op5_quality_rules": _op5_sql(),
        "op9_minhash_neardup": neardup.SQL,
        "op10_line_dedup": linededup.SQL,
        "op11_max_tree_search": lexical.SQL,
        "op13_ball_tree_clusters": balls.SQL,
    }
