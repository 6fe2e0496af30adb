"""Operator 2: personal data, plain and disguised, with offsets in the source text.

Four kinds are found: email, ip, card and phone.  Base spans are those of the plain patterns.  Added spans come from
a normalised copy of the text: a chain of transducers maps homoglyphs and foreign digits one to one, removes invisible
characters, and rewrites spelled digits ("five five five") and disguised @ and . ("name [at] host dot org").  Spelled
digits in a row are read both as one number and as several; of two such spans the one that holds the other counts.  Each
rewrite notes where it stood, the plain patterns run over the copy, and spans found there are mapped back to source
code points.  Only spans that cover a rewrite are added, and none that lies within a base span of the same kind.

A null text counts as an empty one and has no spans.  Texts are read whole.  Rows are independent of each other:
repeated rows give equal results and an empty table an empty one.  found() gives a row for each row, with its doc column
and what was found, and ignores other columns; redacted() carries them along.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_map, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ODD = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain, in linear time: each @ looks back over its own run only."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def spans_of(text: str) -> list[list[tuple[int, int]]]:
    """Plain spans by kind."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)), [], [], []]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out[1] = [m.span() for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g[-9:]) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _ODD.sub("", m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_ODD.sub("", m[0])) <= 15]
    return out


#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ı": "i",
    "•": ".", "。": ".", "․": ".", "·": ".",
}

#: Digits as words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "chez", "klammeraffe")
DOT_WORDS = ("dot", "punto", "punkt", "point")

_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060\ufeff]+")
_word = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_CLOSED_DOT = rf"[ \t]*[\[({{<][ \t]*(?:{_dot}|\.)[ \t]*[\])}}>][ \t]*"
_OPEN_DOT = rf"[ \t]+(?:{_dot})[ \t]+"
#: A bare "at" is one only where a disguised dot follows its host's first label.  Blanks are entered at their start
#: only, so that long runs of them cost no more than their length.
_REWRITE = re.compile(
    rf"(?P<at>(?<![ \t])[ \t]*+[\[({{<][ \t]*(?:{_at}|@)[ \t]*[\])}}>][ \t]*(?=[a-z0-9])"
    rf"|(?<=[a-z0-9_%+-])[ \t]+(?:{_at})[ \t]+(?=[a-z0-9-]+(?:{_CLOSED_DOT}|{_OPEN_DOT})[a-z0-9])"
    rf"|(?<=[a-z0-9_%+-])(?:[ \t]+@[ \t]*|@[ \t]+)(?=[a-z0-9-]+(?:\.|{_CLOSED_DOT}|{_OPEN_DOT})[a-z0-9]))"
    rf"|(?P<dot>(?<=[a-z0-9])(?:{_CLOSED_DOT}|{_OPEN_DOT})(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus[ \t]+(?=(?:{_word}|[0-9])(?![a-z])))"
    rf"|(?P<digit>(?<![^\W_])(?:{_word})(?![^\W_]))",
    re.IGNORECASE,
)
#: The same, but a digit word takes along the blanks before the next one.
_JOINING = re.compile(rf"{_REWRITE.pattern[:-1]}(?:[ \t]+(?=(?:{_word})(?![^\W_])))?)", re.IGNORECASE)
#: Whatever _REWRITE can rewrite to an effect holds one of these, in lower case; they may stand elsewhere too.
_TRIGGER = re.compile(
    rf"[\[({{<][ \t]*(?:{_at}|{_dot}|[@.])[ \t]*[\])}}>]|[ \t](?:{_dot})[ \t]|[ \t]@|@[ \t]|plus[ \t]+(?:{_word}|[0-9])"
)
_BESIDE = r"[ \t().-]+"
_SPELLED = re.compile(rf"(?:{_word}){_BESIDE}(?:{_word}|[0-9])(?![a-z])|(?:{_word}){_BESIDE}[0-9]|[0-9]{_BESIDE}(?:{_word})(?![a-z])")
#: The plain patterns find only parts of mail names with these.
_ACCENTED = tuple(w for w in DIGIT_WORDS if not w.isascii())


class _Plain(dict):
    """One-to-one map of odd characters, worked out on first sight."""

    def __missing__(self, code: int):
        c = chr(code)
        plain = HOMOGLYPHS.get(c)
        if plain is None and code >= 0xA0:
            if unicodedata.category(c) == "Nd":
                plain = str(unicodedata.decimal(c))
            elif unicodedata.category(c) == "Zs":
                plain = " "
            elif unicodedata.category(c) == "Pd" or c == "−":
                plain = "-"
            else:
                wide = unicodedata.normalize("NFKC", c)
                plain = wide if len(wide) == 1 and wide.isascii() and wide.isprintable() else c
        self[code] = plain or c
        return self[code]


_PLAIN = _Plain()


class Rewritten:
    """A text after rewrites, with where each rewritten stretch stood in the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.new, self.old, at, out = [], [0], [0], 0, 0
        self.stretches = []  # (start, end) in the new text
        for start, end, by in edits:
            parts += [text[at:start], by]
            out += start - at
            self.stretches.append((out, out + len(by)))
            self.new.append(out)
            self.old.append(start)
            out += len(by)
            self.new.append(out)
            self.old.append(end)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)
        self.inside = {a: (s, e) for (a, b), (s, e, _) in zip(self.stretches, edits) if b > a}

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the text before that became new[start:end].  Rewrites are of one character or none."""
        i = bisect.bisect_right(self.new, start) - 1
        first = self.inside[start][0] if start in self.inside else self.old[i] + start - self.new[i]
        last = end - 1
        if last in self.inside:
            return first, self.inside[last][1]
        i = bisect.bisect_right(self.new, last) - 1
        return first, self.old[i] + last - self.new[i] + 1


def _low(text: str) -> str:
    """Lower case, as patterns that ignore case see it."""
    return text.lower().replace("i\u0307", "i")


def _rewrites(text: str, pattern: re.Pattern = _REWRITE) -> list[tuple[int, int, str]]:
    out = []
    for m in pattern.finditer(text):
        kind = m.lastgroup
        by = {"at": "@", "dot": ".", "plus": "+"}.get(kind) or DIGIT_WORDS[_low(m[0]).rstrip(" \t")]
        out.append((m.start(), m.end(), by))
    return out


def _disguised(text: str) -> bool:
    """Whether the normalised copy can show anything: a character that is mapped or removed, or a form to rewrite."""
    if not text.isascii() and any(_PLAIN[ord(c)] != c or _INVISIBLE.match(c) for c in set(text)):
        return True
    low = _low(text)
    if _TRIGGER.search(low) or _SPELLED.search(low):
        return True
    return "@" in low and any(w in low for w in _ACCENTED)


def added_spans(text: str, base: list[list[tuple[int, int]]], gate: bool = True) -> list[list[tuple[int, int]]]:
    """Spans that only the normalised copy shows, by kind.  The gate saves time and changes nothing."""
    if gate and not _disguised(text):
        return [[], [], [], []]
    plain = text if text.isascii() else text.translate(_PLAIN)
    one = Rewritten(plain, [(*m.span(), "") for m in _INVISIBLE.finditer(plain)])
    edits, joining = _rewrites(one.text), _rewrites(one.text, _JOINING)
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    # Joined digits first; those apart show what joining spoils, as an address after a count.
    for two in [Rewritten(one.text, e) for e in ([joining, edits] if joining != edits else [edits])]:
        for kind, found in enumerate(spans_of(two.text)):
            new = []
            for start, end in found:
                if kind == 0 and not re.search(r"\.[A-Za-z]{2,}$", two.text[start:end]):
                    continue
                a, b = two.source(start, end)
                a, b = one.source(a, b)
                if text[a:b] != two.text[start:end] and not any(s <= a and b <= e for s, e in base[kind] + out[kind]):
                    new.append((a, b))
            out[kind] += new
    return out


def detect(text: str | None):
    text = text or ""
    base = spans_of(text)
    return base, added_spans(text, base)


def _names(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k in range(4) for a, b in sorted(spans[k]))


def redacted_text(text: str) -> str:
    """text with every span, base or added, replaced by its kind in brackets; overlapping spans become one."""
    base, added = detect(text)
    spans = sorted((a, -b, k) for k in range(4) for a, b in base[k] + added[k])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def found(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc, counts of base spans by kind, base and all spans as strings, number of added ones."""

    def run(ids, texts):
        rows = []
        for t in texts:
            base, added = detect(t)
            every = [sorted(b + a) for b, a in zip(base, added)]
            rows.append([*map(len, base), _names(base), _names(every), sum(map(len, added))])
        return [ids, *(list(x) for x in zip(*rows))] if rows else [[]] * 8

    kind = df.schema[doc].dataType.simpleString()
    schema = f"{doc} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long"
    return arrow_map(df.select(doc, text), run, schema)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in its texts replaced."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cover(texts):
        return texts.map(lambda t: None if t is None else redacted_text(t))

    return df.withColumn(text, cover(F.col(text)))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    out = found(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and n_chars brought up to date."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
