"""Operator 5: quality rules.

A table of thresholds is compiled into one Spark projection; no user function runs.  Words are runs of anything but
blank, tab, line feed, vertical tab, form feed and carriage return.  A null text counts as an empty one, which has no
words, lines or symbols and fails the base rule.  Each row is judged by itself: repeated rows get equal verdicts,
an empty table gives an empty one, and other columns pass through untouched unless their names are those of the
measures, which are replaced, whatever else they are called.  stage() leaves all columns as they are.  Windows of
three words are compared by 64-bit hashes, so n_repeat_words is exact but for a collision of those within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, SPACE_CLASS, WORD_CLASS, carried, fresh, restored, table

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is in it for as was on are by this at from or an a not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des du et un une que dans est pour qui sur pas par au plus "
    "el los las y en del se con por para una lo como no su al"
).split()

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Keeps rows whose measure lies within [low, high]; None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rule of the contract is apart; these are the method's own thresholds.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.50),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(h: str, sorted_h: str) -> Column:
    """Words covered by windows that occur twice: of windows sorted by hash, those equal to a neighbour; each start
    covers three words or as many as there are up to the next start."""
    n = F.size(sorted_h)
    equal = F.zip_with(
        F.slice(sorted_h, 1, n - 1),
        F.slice(sorted_h, 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures of every whole text."""
    keep = [c for c in df.columns if c not in MEASURES]
    if any(c != text and c.lower().startswith(("_q_", "_n_")) for c in keep):
        # Names that the columns below take: the others stand aside.
        aside = {c: fresh(df, f"aside{i}") for i, c in enumerate(keep) if c != text}
        named = measured(df.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in keep)), text)
        return named.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in keep), *MEASURES)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.select(*(F.col(f"`{c}`") for c in keep), raw.alias("_q_text"), F.btrim(raw, F.lit(SPACE)).alias("_q_trim"))
    df = df.withColumns({
        "_q_words": F.when(F.col("_q_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_q_trim", SPACE_CLASS + "+")),
        "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD_CLASS)),
        "n_symbols": F.length(F.regexp_replace("_q_text", "[^#*$%&|<>]+", "")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "_n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_n_stop": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "_n_bullets": F.size(F.filter("_q_lines", lambda x: x.rlike(r"^\s*[-*•]"))),
        "_n_ellipses": F.size(F.filter("_q_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)),
    })
    n = F.size("_q_hash")
    df = df.withColumn(
        "_q_windows",
        F.when(
            n >= 3,
            F.zip_with(
                F.zip_with(F.slice("_q_hash", 1, n - 2), F.slice("_q_hash", 2, n - 2), lambda a, b: F.xxhash64(a, b)),
                F.slice("_q_hash", 3, n - 2),
                lambda a, b: F.xxhash64(a, b),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    df = df.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn("_q_starts", F.when(F.col("_q_sorted").isNotNull(), _repeat_words("_q_windows", "_q_sorted")))
    m = F.size("_q_starts")
    covered = F.aggregate(
        F.zip_with(F.slice("_q_starts", 1, m - 1), F.slice("_q_starts", 2, m - 1), lambda a, b: F.least(F.lit(3), b - a)),
        F.lit(3),
        lambda s, x: s + x,
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_q_starts").isNotNull(), covered).otherwise(0).cast("long"))
    words, lines = F.col("n_words"), F.col("_n_lines")
    return df.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), words),
        "symbol_ratio": _ratio(F.col("n_symbols"), words),
        "stop_ratio": _ratio(F.col("_n_stop"), words),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("_n_bullets"), lines),
        "ellipsis_line_ratio": _ratio(F.col("_n_ellipses"), lines),
    }).select(*(F.col(f"`{c}`") for c in keep), *MEASURES)


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio",
    "stop_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio",
)


def compiled(rules=RULES) -> Column:
    """The table of thresholds as one condition."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= r.high)
    return ok


def judged(df: DataFrame, rules=RULES, text: str = "text", min_words: int = 50) -> DataFrame:
    """df with the measures, base_failed and kept."""
    df = measured(df.drop("base_failed", "kept"), text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    A filter on a plain column would be pushed through the projections and its whole expression written out in it,
    many times over; one on a column that counts as indeterminate stays above them.  The term is always true."""
    marked = judged(carried(docs, "text")).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return restored(marked.where("kept"), docs, ("text",))
