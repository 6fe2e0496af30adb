"""The qualitative report of two rankers, as Markdown.  Tables of errors are as long as there are errors; everything else
is a few lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import analysis, metrics
from matchloom.sources.files import markdown
from matchloom.sources.shared import stored


def _number(x) -> str:
    return "-" if x is None else f"{x:.3f}"


def qualitative(ranked: dict[str, DataFrame], queries: DataFrame, gold: DataFrame, names: DataFrame) -> str:
    """ranked: two named rankings; queries: query_id, text; gold: query_id, gold; names: ord, id, name."""
    rows = {n: stored(analysis.judged(analysis.nested(r, queries, gold, names)), "judged") for n, r in ranked.items()}
    out = []
    for name, judged in rows.items():
        n, hits = judged.agg(F.count("*"), F.count_if("correct")).first()
        out.append(f"## {name}: {hits} of {n} right, {n - hits} wrong (P@1 {_number(hits / n if n else None)})\n")
        shown = analysis.examples(judged).withColumn("score", F.format_string("%.3f", "score")).orderBy("query_id")
        out.append("Right, the first of them:\n\n" + markdown(shown.where("correct"), {"text": "query", "found": "found", "score": "score"}))
        heads = {"text": "query", "gold_name": "expected", "found": "found", "position": "place of the right one", "diagnosis": "diagnosis"}
        out.append("Wrong, all of them:\n\n" + markdown(shown.where("NOT correct"), heads))
    first, second = rows
    sides = analysis.error_sets(rows[first], rows[second]).join(queries, "query_id")
    counts = {r.side: r.n for r in sides.groupBy("side").agg(F.count("*").alias("n")).collect()}
    out.append("## Errors side by side\n")
    for side, of in (("only_one", f"of {first} only"), ("only_two", f"of {second} only"), ("both", "of both")):
        out.append(f"- {of}: {counts.get(side, 0)}")
        out += [f"  - {r.text}" for r in sides.where(F.col("side") == side).orderBy("query_id").limit(6).collect()]
    close = analysis.ambiguous(ranked[first], names.select("ord", "name")).join(queries, "query_id").orderBy("query_id")
    why = F.when(F.col("duplicate_name"), "several products of this name").otherwise("scores nearly tie")
    close = close.withColumn("why", why).withColumn("delta", F.format_string("%.4f", "delta"))
    out.append("\n## Ambiguous\n\n" + markdown(close, {"text": "query", "name_1": "first", "name_2": "second", "delta": "difference", "why": "why"}))
    stats = {r.correct: r for r in metrics.score_stats(rows[first], "correct").collect()}
    out.append("## Rejection\n")
    for correct, word in ((True, "right"), (False, "wrong")):
        if r := stats.get(correct):
            out.append(f"- scores of {word} first matches: mean {_number(r.mean)}, p5 {_number(r.p5)}, from {_number(r.min)} to {_number(r.max)}")
    if True in stats:
        out.append(f"- a match below {_number(stats[True].p5)} would be left open: that costs a twentieth of the right ones")
    return "\n".join(out) + "\n"
