"""DuckDB twins of the engine's building blocks, as fragments of common table expressions."""

from __future__ import annotations

from matchloom.functions.tables import ABBREVIATIONS, PACK_WORDS, REWRITES, STOPWORDS, UNITS

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def _map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in entries.items()) + "}"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def normal(source: str, name: str) -> str:
    """CTEs ending in `name`: the columns of source, which has text, with toks and doc."""
    t = "strip_accents(lower(coalesce(text, '')))"
    for pattern, by, follows in REWRITES:
        # No look-ahead here: what follows is taken and put back.
        pattern, by = (f"{pattern}({follows})", by + r"\1") if follows else (pattern, by)
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    number = r"regexp_full_match({}, '\d+(\.\d+)?')"
    return rf"""
{name}_p AS (SELECT *, list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '') AS p FROM {source}),
{name}_t AS (
  SELECT * EXCLUDE (p), list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE
    WHEN i > 1 AND {number.format("p[i - 1]")} AND {_map(UNITS)}[p[i]] IS NOT NULL THEN NULL
    WHEN {number.format("p[i]")} AND i < len(p) AND {_map(UNITS)}[p[i + 1]] IS NOT NULL THEN
      CASE WHEN {_map(UNITS)}[p[i + 1]] = '' THEN NULL
           WHEN contains(p[i], '.') THEN regexp_replace(regexp_replace(p[i], '0+$', ''), '\.+$', '') || {_map(UNITS)}[p[i + 1]]
           ELSE p[i] || {_map(UNITS)}[p[i + 1]] END
    WHEN p[i] IN {_list(PACK_WORDS)} OR coalesce({_map(UNITS)}[p[i]], '-') = '' THEN NULL
    WHEN coalesce({_map(ABBREVIATIONS)}[p[i]], p[i]) IN {_list(STOPWORDS)} THEN NULL
    ELSE coalesce({_map(ABBREVIATIONS)}[p[i]], p[i]) END), lambda x: x IS NOT NULL) AS toks
  FROM {name}_p
),
{name} AS (SELECT *, array_to_string(toks, ' ') AS doc FROM {name}_t)"""


def postings(docs: str, name: str, vocabulary: str = "") -> str:
    """CTEs {name}_t: term, n, df, idf; and {name}_w: the BM25 weight of each posting.  docs: ord, toks.  vocabulary, a
    relation of terms, keeps the postings to what is asked for; counts are per term, so nothing else changes."""
    kept = f" WHERE term IN (SELECT term FROM {vocabulary})" if vocabulary else ""
    return f"""
{name}_st AS (SELECT count(*)::double AS n, avg(len(toks)) AS avgdl FROM {docs}),
{name}_p AS (SELECT ord, dl, term, count(*) AS tf FROM (SELECT ord, len(toks) AS dl, unnest(toks) AS term FROM {docs}){kept} GROUP BY ALL),
{name}_t AS (
  SELECT term, any_value(n) AS n, count(*) AS df, ln((any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double) + 1::double) AS idf
  FROM {name}_p, {name}_st GROUP BY term
),
{name}_w AS (
  SELECT p.term, ord, tf, dl, df, idf, idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)) AS weight
  FROM {name}_p p JOIN {name}_t t ON p.term = t.term, {name}_st
)"""


def bm25(docs: str, queries: str, name: str) -> str:
    """CTEs ending in `name`: query_id, ord, score.  docs: ord, toks; queries: query_id, toks."""
    return f"""
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS term FROM {queries}) GROUP BY ALL),{postings(docs, name, name + '_q')},
{name} AS (
  SELECT query_id, ord, round(sum(qtf * weight), 6) AS score FROM {name}_q q JOIN {name}_w w ON q.term = w.term GROUP BY ALL
)"""


def char_wb(doc: str) -> str:
    def grams(n: int) -> str:
        cut = f"list_transform(range(1, len(w) + 4 - {n}), lambda i: substr(' ' || w || ' ', i, {n}))"
        return f"CASE WHEN len(w) + 2 >= {n} THEN {cut} ELSE {"[' ' || w || ' ']" if n == 3 else '[]'} END"

    words = f"list_filter(string_split({doc}, ' '), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: {grams(3)} || {grams(4)} || {grams(5)}))"


def hashed(source: str, key: str, terms: str, name: str, size: int = 64) -> str:
    """CTEs ending in `name`: the columns of source and v, the unit vector of its hashed terms."""
    return f"""
{name}_h AS (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::int AS h FROM (SELECT {key}, unnest({terms}) AS term FROM {source})),
{name}_c AS (SELECT {key}, h % {size} AS place, sum(CASE WHEN (h // {size}) % 2 = 0 THEN 1 ELSE -1 END)::double AS x FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS norm, map(list(place), list(x)) AS m FROM {name}_c GROUP BY {key}),
{name} AS (
  SELECT s.*, list_transform(range(0, {size}), lambda i: CASE WHEN coalesce(n.norm, 0) = 0 THEN 0::double ELSE (coalesce(n.m[i], 0) / n.norm)::float::double END) AS v
  FROM {source} s LEFT JOIN {name}_n n ON s.{key} = n.{key}
)"""


def dense(docs: str, queries: str, name: str) -> str:
    return f"""
{name} AS (SELECT query_id, ord, round(list_dot_product(q.v, d.v), 6) AS score FROM {queries} q, {docs} d)"""


def hybrid(docs: str, queries: str, name: str, k: int = 5, candidates: int = 50) -> str:
    """CTEs ending in `name`: the k best.  docs: ord, toks, v; queries: query_id, toks, v."""
    return f"""{bm25(docs, queries, name + "_s")}, {padded(name + "_s", queries, docs, candidates, name + "_z")}, {top(name + "_z", candidates, name + "_c")},
{name}_h AS (
  SELECT c.query_id, c.ord, c.rank AS bm25_rank, round(list_dot_product(q.v, d.v), 6) AS score
  FROM {name}_c c JOIN {docs} d ON c.ord = d.ord JOIN {queries} q ON c.query_id = q.query_id
), {top(name + "_h", k, name, "bm25_rank")}"""


def bigrams(doc: str) -> str:
    w = WORDS.format(doc)
    return f"{w} || list_transform(list_zip({w}, {w}[2:], true), lambda x: x[1] || ' ' || x[2])"


def tfidf(docs: str, queries: str, terms, name: str) -> str:
    """CTEs ending in `name`: query_id, ord, score.  docs: ord, doc; queries: query_id, doc."""
    return f"""
{name}_c AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({terms("doc")}) AS term FROM {docs}) GROUP BY ALL),
{name}_n AS (SELECT count(*)::double AS n FROM {docs}),
{name}_t AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*)::double)) + 1 AS idf FROM {name}_c, {name}_n GROUP BY term),
{name}_w AS (SELECT ord, c.term, (1 + ln(tf)) * idf AS w FROM {name}_c c JOIN {name}_t t ON c.term = t.term),
{name}_d AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY ord),
{name}_qc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({terms("doc")}) AS term FROM {queries}) GROUP BY ALL),
{name}_qw AS (SELECT query_id, c.term, (1 + ln(tf)) * idf AS w FROM {name}_qc c JOIN {name}_t t ON c.term = t.term),
{name}_qd AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM {name}_qw GROUP BY query_id),
{name} AS (
  SELECT q.query_id, d.ord, round(sum((q.w / qn.norm) * (d.w / dn.norm)), 6) AS score
  FROM {name}_qw q JOIN {name}_qd qn ON q.query_id = qn.query_id JOIN {name}_w d ON q.term = d.term JOIN {name}_d dn ON d.ord = dn.ord
  GROUP BY ALL
)"""


def padded(scored: str, queries: str, docs: str, k: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, ord, score FROM {scored}
  UNION ALL
  SELECT q.query_id, d.ord, 0::double FROM {queries} q, (SELECT ord FROM {docs} ORDER BY ord LIMIT {k}) d
  WHERE NOT EXISTS (SELECT 1 FROM {scored} s WHERE s.query_id = q.query_id AND s.ord = d.ord)
)"""


def top(scored: str, k: int, name: str, ties: str = "ord", keep: str = "") -> str:
    return f"""
{name} AS (
  SELECT query_id, rank, ord, score{keep} FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM {scored}
  ) WHERE rank <= {k}
)"""


def hits(ranked: str, gold: str, k: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT g.query_id, min(CASE WHEN r.ord = g.gold AND r.rank <= {k} THEN r.rank END) AS hit
  FROM {gold} g LEFT JOIN {ranked} r ON g.query_id = r.query_id GROUP BY g.query_id
)"""


MEASURES = """avg(CASE WHEN hit = 1 THEN 1::double ELSE 0 END) AS p1, avg(coalesce(1::double / hit, 0)) AS mrr,
       avg(CASE WHEN hit IS NOT NULL THEN 1::double ELSE 0 END) AS recall, count(*) AS n"""
