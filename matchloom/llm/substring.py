"""Operator 6: repeated lines, paragraphs and passages.

A text is cut into units, its lines or paragraphs, which tile it: a unit reaches from the start of its first line to
the end of the line breaks after it.  A unit is normalised (lower case, words one blank apart) and hashed to 128 bits;
units without a word are none.  Digests are grouped over all documents, the occurrence in the least doc_id, and there
the first, is kept, and every other one is marked.  Only marked text is removed, whatever stands beside it.  unit_words
leaves out shorter units; by default none is.

A passage may start and end within lines.  So every window of passage_words words that stands before, wherever it
starts, is marked too, unless it overlaps its own first occurrence.  Not every window is shuffled.  Of the hashes of
half as many words in a window the least is its fingerprint, a function of the window alone, so equal windows have equal
ones; a run of windows mostly shares one, and is one row.  A row's class is its fingerprint with all the words that its
windows can reach (75 around).  Of a class only the first row can hold a window's first occurrence, so every other row
is marked as it stands; and where a fingerprint has several classes, the windows of their first rows alone are hashed
one by one and grouped.  The result is that of all windows.

Spans of a document that meet become one.  Offsets are code points of the source text, end exclusive; first_doc_id is
an earlier document (or the same) that holds some unit of the span.  The shuffle carries digests and numbers; texts are
dealt by doc_id only where windows are hashed.  Counts and first occurrences are partial aggregates, written before
they are joined, so a unit that stands in a third of all documents is one row a task, and Spark can split its join.

Null and empty texts have no units.  Rows that share a doc_id are one document, whose offsets are those of either row;
rows with a null doc_id are passed over.  An empty table gives an empty result; extra columns are ignored by spans();
deduplicated() carries them along, but for kept_offsets, which it replaces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import afresh, arrow_map, by_ids, fresh, table, written

#: Line feeds between words that end a unit.
BREAKS = {"line": 1, "paragraph": 2}
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


class Words:
    """The words of some texts, in a row: hashes, and where they stand."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        texts = [t or "" for t in texts]
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        space = np.concatenate([[True], _SPACE[np.minimum(codes, len(_SPACE) - 1)], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.stops = edges[::2], edges[1::2]
        self.breaks = np.flatnonzero(codes == 10)
        n = len(self.starts)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, joined.lower().split()), np.uint64, n)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        counts = np.diff(np.append(np.searchsorted(self.starts, self.begins), n))
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.first = (np.cumsum(counts) - counts)[self.doc]  # of each word's text: its first word, and the next text's
        self.next = self.first + counts[self.doc]
        # The second hash is of other numbers, not only of another base.
        self._sums = [self._summed(self.hashes, _BASES[0]), self._summed(self.hashes ^ (self.hashes >> np.uint64(31)), _BASES[1])]

    @staticmethod
    def _summed(hashes, base: int):
        n = len(hashes)
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        return np.append(np.uint64(0), np.cumsum(hashes * power[:n])), back

    def digest(self, which: int, a, b, salt=0):
        """Of words a to b, by one of two hashes."""
        sums, back = self._sums[which]
        g = (sums[b] - sums[a]) * back[a] + np.asarray(b - a + salt).astype(np.uint64)
        g = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return g ^ (g >> np.uint64(29))

    def units(self, unit: str):
        """First word, word after the last, start and stop of every unit that has words."""
        before = np.searchsorted(self.breaks, self.starts)
        new = np.append(True, (np.diff(before) >= BREAKS[unit]) | (np.diff(self.doc) != 0))[: len(self.starts)]
        w0 = np.flatnonzero(new)
        w1 = np.append(w0[1:], len(self.starts))[: len(w0)]
        doc = self.doc[w0]
        leads = np.append(True, doc[1:] != doc[:-1])[: len(w0)]
        start = np.where(leads, self.begins[doc], np.append(0, self.breaks + 1)[before[w0]])
        ends = self.begins[doc] + self.lengths[doc]
        stop = np.where(np.append(leads[1:], True)[: len(w0)], ends, np.append(start[1:], 0)[: len(w0)])
        return w0, w1, start, stop

    def fingerprints(self, words: int):
        """Each run of windows with one fingerprint: where that starts, first window, last window."""
        k = (words + 1) // 2
        n = len(self.starts)
        at = np.arange(n - words + 1)
        if not len(at):
            return at, at, at
        g = self.digest(0, np.arange(n - k + 1), np.arange(k, n + 1))
        view = np.lib.stride_tricks.sliding_window_view(g, words - k + 1)
        where = np.concatenate([view[x : x + 8192].argmin(1) for x in range(0, len(view), 8192)]) + at
        whole = self.doc[at] == self.doc[at + words - 1]
        where, at = where[whole], at[whole]
        first = np.flatnonzero(np.append(True, (np.diff(where) != 0) | (np.diff(self.doc[at]) != 0))[: len(at)])
        last = np.append(first[1:], len(at))[: len(first)] - 1
        return where[first], at[first], at[last]


COLUMNS = "h1 long, h2 long, doc_id long, w0 int, w1 int, start int, stop int, passage boolean"


def hashed_units(df: DataFrame, unit: str = "line", unit_words: int = 1, passage_words: int | None = 51, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per unit, and per run of windows with one fingerprint; h1 and h2 are the digest or the class."""

    def run(ids, texts):
        w, ids = Words(texts), np.array(ids, np.int64)
        w0, w1, start, stop = w.units(unit)
        keep = w1 - w0 >= unit_words
        w0, w1, start, stop = w0[keep], w1[keep], start[keep], stop[keep]
        h1, h2 = w.digest(0, w0, w1), w.digest(1, w0, w1)
        n = len(w0)
        if passage_words:
            at, low, high = w.fingerprints(passage_words)
            half = (passage_words + 1) // 2
            a = np.maximum(at - passage_words + half, w.first[low])
            b = np.minimum(at + passage_words, w.next[low])
            h1 = np.append(h1, w.digest(0, at, at + half))
            h2 = np.append(h2, w.digest(1, a, b, (at - a) * 1_000_003))
            w0, w1 = np.append(w0, low), np.append(w1, high + passage_words)
            start, stop = np.append(start, w.starts[low]), np.append(stop, w.stops[high + passage_words - 1])
        of = w.doc[w0]
        base, begin = w.first[w0], w.begins[of]
        return [h1.view(np.int64), h2.view(np.int64), ids[of], w0 - base, w1 - base, start - begin, stop - begin, np.arange(len(w0)) >= n]

    named = df.select(F.col(doc).cast("long"), F.col(text).cast("string")).where(F.col(doc).isNotNull())
    return arrow_map(named, run, COLUMNS, rows=64)


def _windows(df: DataFrame, needed: DataFrame, words: int, doc: str, text: str) -> DataFrame:
    """A row per window that needed (doc_id, w0, w1) covers."""

    def run(ids, texts, ranges):
        w, ids = Words(texts), np.array(ids, np.int64)
        counts = np.bincount(w.doc, minlength=len(texts))
        first = np.cumsum(counts) - counts
        i = [np.arange(r["w0"], min(r["w1"], n) - words + 1) + f for n, f, rs in zip(counts, first, ranges) for r in rs]
        i = np.unique(np.concatenate([*i, np.empty(0, np.int64)]).astype(np.int64))
        of = w.doc[i]
        base, begin = w.first[i], w.begins[of]
        h1, h2 = w.digest(0, i, i + words), w.digest(1, i, i + words)
        return [h1.view(np.int64), h2.view(np.int64), ids[of], i - base, i - base + words, w.starts[i] - begin, w.stops[i + words - 1] - begin, np.ones(len(i), bool)]

    ranges = needed.groupBy(F.col("doc_id").alias("of_id")).agg(F.collect_set(F.struct("w0", "w1")).alias("ranges"))
    ranges = written(ranges, "ranges")
    texts = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = by_ids(texts, "doc_id", ranges.select("of_id"), "left_semi")
    held = texts.join(ranges, F.col("doc_id") == F.col("of_id")).select("doc_id", "text", "ranges")
    return arrow_map(held, run, COLUMNS, rows=64)


def _with_first(rows: DataFrame) -> DataFrame:
    """rows with the document and word where their class stands first, and how many classes their h1 has."""
    key = ("passage", "h1", "h2")
    firsts = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "w0")).alias("f"))
    classes = firsts.groupBy(F.col("passage").alias("_p"), F.col("h1").alias("_h")).agg(F.count("*").alias("classes"))
    firsts = firsts.join(classes, (F.col("passage") == F.col("_p")) & (F.col("h1") == afresh(F.col("_h"))))
    firsts = firsts.select(
        F.col("passage").alias("k0"), F.col("h1").alias("k1"), F.col("h2").alias("k2"),
        F.col("f.doc_id").alias("first_doc_id"), F.col("f.w0").alias("first_w0"), "classes",
    )
    firsts = written(firsts, "firsts")
    met = rows.join(firsts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("passage") == F.col("k0")))
    return met.drop("k0", "k1", "k2")


def spans(df: DataFrame, unit: str = "line", unit_words: int = 1, passage_words: int | None = 51, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans to remove: doc_id, span_start, span_end, n_units, n_words and first_doc_id.  n_units counts units and
    runs of windows; without passage_words only units are looked at."""
    every = written(hashed_units(df, unit, unit_words, passage_words, doc, text), "units")
    several = every.groupBy(F.col("h1").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of")
    again = written(every.join(written(several, "several"), F.col("h1") == F.col("of")).drop("of"), "again")
    met = written(_with_first(again), "met")
    here = F.col("doc_id") == F.col("first_doc_id")
    # A unit is never its own copy; windows that overlap their first occurrence are not either.
    lag = F.when(F.col("passage"), F.lit(passage_words or 1)).otherwise(F.lit(1))
    apart = ~here | (F.col("w0") - F.col("first_w0") >= lag)
    marked = met.where(apart)
    if passage_words:
        unsure = met.where(F.col("passage") & ~apart & (F.col("classes") > 1)).select("doc_id", "w0", "w1")
        whole = written(_windows(df, unsure, passage_words, doc, text), "windows")
        marked = marked.unionByName(_with_first(whole).where(apart))
    marked = marked.select("doc_id", "start", "stop", "w0", "w1", "first_doc_id")
    return _united(marked.dropDuplicates(["doc_id", "start", "stop"]))


def _united(marked: DataFrame) -> DataFrame:
    """Spans of a document that meet become one."""
    before = Window.partitionBy("doc_id").orderBy("start", "stop")
    marked = marked.withColumn("high", F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.when(F.col("high") >= F.col("start"), 0).otherwise(1)
    marked = marked.withColumn("nth", F.sum(apart).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "nth").agg(
        F.min("start").cast("long").alias("span_start"),
        F.max("stop").cast("long").alias("span_end"),
        F.count("*").alias("n_units"),
        (F.max("w1") - F.min("w0")).cast("long").alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"),
    ).drop("nth")


def deduplicated(df: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with the spans taken out of its texts, and kept_offsets: (start, end) in the source text of what is left."""
    of, spans_col = fresh(df, "_gone_id"), fresh(df, "_gone")
    gone = spans(df, doc=doc, text=text, **how).groupBy(F.col("doc_id").alias(of))
    gone = gone.agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias(spans_col))
    joined = df.drop("kept_offsets").join(gone, F.col(doc) == F.col(of), "left")
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_col, lambda s: s["span_end"]))
    ends = F.concat(F.transform(spans_col, lambda s: s["span_start"]), F.array(length))
    between = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s: s["start"] < s["end"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), length.alias("end")))
    joined = joined.withColumn("kept_offsets", F.when(F.col(spans_col).isNull(), whole).otherwise(between))
    left = F.array_join(F.transform("kept_offsets", lambda s: F.substring(F.col(text), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    columns = [c for c in df.columns if c != "kept_offsets"]
    return joined.select(*(F.when(F.col(spans_col).isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in columns), "kept_offsets")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
