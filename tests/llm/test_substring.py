import re
from collections import defaultdict

import pytest
from matchloom.llm import substring as S
from tests.llm import docs

BREAK = {"line": r"\n\s*", "paragraph": r"\n[^\S\n]*\n\s*"}


def tiles(text, unit):
    """(start, end, words) of the units of a text, cut by a pattern."""
    text, out, at = text or "", [], 0
    for m in re.finditer(BREAK[unit], text):
        if text[at : m.start()].strip():
            if text[m.end() :].strip():
                end = m.start() + m[0].rindex("\n") + 1
                out.append((at, end, text[at:end].lower().split()))
                at = end
    if text[at:].strip():
        out.append((at, len(text), text[at:].lower().split()))
    return out


def brute_units(data, unit, unit_words=1):
    """doc -> marked (start, end)."""
    where = defaultdict(list)
    for d, t in data:
        for a, b, words in tiles(t, unit):
            if len(words) >= unit_words:
                where[" ".join(words)].append((d, a, b))
    gone = defaultdict(set)
    for found in where.values():
        for d, a, b in set(found) - {min(found)}:
            gone[d].add((a, b))
    return gone


def brute_windows(data, words):
    """doc -> marked (start, end)."""
    at = defaultdict(list)
    edges = {}
    for d, t in data:
        edges[d] = [m.span() for m in re.finditer(r"\S+", t or "")]
        w = (t or "").lower().split()
        for i in range(len(w) - words + 1):
            at[tuple(w[i : i + words])].append((d, i))
    gone = defaultdict(set)
    for found in at.values():
        d0, i0 = min(found)
        for d, i in found:
            if d != d0 or i - i0 >= words:
                gone[d].add((edges[d][i][0], edges[d][i + words - 1][1]))
    return gone


def united(*every):
    out = []
    for d in set().union(*every):
        run = []
        for a, b in sorted(set().union(*(x.get(d, set()) for x in every))):
            if run and a <= run[-1][1]:
                run[-1][1] = max(b, run[-1][1])
            else:
                run.append([a, b])
        out += [(d, *x) for x in run]
    return sorted(out)


def distinct():
    return list({d: t for d, t, *_ in docs.rows() if d is not None}.items())


def got(df, **how):
    rows = S.spans(df, **how).collect()
    assert all(r.first_doc_id <= r.doc_id and r.n_units > 0 and r.n_words > 0 for r in rows)
    return sorted((r.doc_id, r.span_start, r.span_end) for r in rows)


@pytest.mark.parametrize(("unit", "least"), [("line", 1), ("line", 4), ("paragraph", 1)])
def test_units_match_brute_force(spark, unit, least):
    want = united(brute_units(distinct(), unit, least))
    assert want
    assert got(docs.frame(spark), unit=unit, unit_words=least, passage_words=None) == want


@pytest.mark.parametrize("words", [51, 30, 7])
def test_all_matches_brute_force(spark, words):
    want = united(brute_units(distinct(), "line"), brute_windows(distinct(), words))
    assert got(docs.frame(spark), passage_words=words) == want


def test_windows_of_near_copies_match_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    data = []
    for d in range(25):
        w = list(base)
        for _ in range(d % 6):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = [f"n{rng.randrange(9)}"] * rng.randrange(1, 4)
        cut = rng.randrange(150)
        w = w[cut : cut + rng.randrange(60, 300)] + (["again", "and"] * 40 if d % 5 == 0 else []) + w[:70]
        data.append((d, " ".join(w)))
    for words in (51, 20):
        want = united(brute_units(data, "line"), brute_windows(data, words))
        assert want
        assert got(spark.createDataFrame(data, "doc_id long, text string"), passage_words=words) == want


def test_unique_text_stays(spark):
    a, b = "First thing that is told here.", "Another thing that is told here."
    texts = [f"{a}\n{b}", f"{a}\nCall Bob.\n{b}", f"{a} Call Bob. {b}", f"  {a.upper()}\n\n    own line\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in S.deduplicated(df).collect()}
    assert left == {0: texts[0], 1: "Call Bob.\n", 2: texts[2], 3: "    own line\n"}


def test_texts_and_offsets(spark):
    source = {d: t for d, t, *_ in docs.rows()}
    spans = defaultdict(set)
    for d, a, b in got(docs.frame(spark)):
        spans[d].add((a, b))
    rows = S.deduplicated(docs.frame(spark)).collect()
    assert len(rows) == len(docs.rows())
    for r in rows:
        t = source[r.doc_id]
        drop = {i for a, b in spans[r.doc_id] for i in range(a, b)}
        assert (r.text or "") == "".join(c for i, c in enumerate(t or "") if i not in drop)
        if spans[r.doc_id]:
            assert r.text == "".join(t[x.start : x.end] for x in r.kept_offsets)


def test_empty_null_ids_and_clashes(spark):
    assert S.spans(docs.empty(spark)).count() == 0
    assert S.deduplicated(docs.empty(spark)).count() == 0
    line = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, line, 1), (None, line, 2), (5, line, 3)], "doc_id long, text string, h1 int")
    assert S.spans(df).count() == 0
    clash = df.withColumnsRenamed({"h1": "_gone"}).selectExpr("*", "1 AS _Gone_ID", "2 AS kept_offsets")
    assert S.deduplicated(clash).count() == 3


def test_rows_of_one_id(spark):
    df = spark.createDataFrame([(1, "a line"), (1, "a line"), (1, "other\na line"), (2, "a line")], "doc_id long, text string")
    assert got(df) == [(1, 6, 12), (2, 0, 6)]


def test_passages_go_wherever_they_start(spark):
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    quote = word("q", 51)
    three = [w + "." * (i % 17 == 16) for i, w in enumerate(word("s", 51))]
    loop = (word("l", 7) * 30)[:200]
    texts = [
        " ".join(word("a", 9) + quote + word("b", 9)),
        " ".join(word("c", 30) + [w.upper() for w in quote] + word("d", 70)),  # inside one sentence
        " ".join(word("e", 5) + three + word("f", 5)),
        " ".join(word("g", 40) + three + word("h", 3)),
        " ".join(word("i", 9) + quote[1:] + word("j", 9)),  # 50 words only
        " ".join(loop),  # overlaps itself up to word 56
        "x  ".join(word("k", 3)) + "\n" + "\n".join(quote) + "  y",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {(d, *texts[d][a:b].lower().split()) for d, a, b in got(df)}
    assert cut == {(1, *quote), (3, *three), (5, *loop[56:]), (6, *quote)}
    left = {r.doc_id: r.text.split() for r in S.deduplicated(df).collect()}
    assert left[1] == word("c", 30) + word("d", 70) and left[4] == texts[4].split() and left[0] == texts[0].split()


def test_a_unit_in_a_third_of_all_documents(spark):
    hot = " ".join(f"hot{i}" for i in range(60))
    data = [(d, (f"{hot}\n" if d % 3 == 0 else "") + f"{d} is my own") for d in range(600)]
    assert got(spark.createDataFrame(data, "doc_id long, text string")) == [(d, 0, len(hot) + 1) for d in range(3, 600, 3)]
