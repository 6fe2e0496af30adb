"""Text functions as Columns: the retail normaliser, tokenisers and n-gram generators.  No user functions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.tables import ABBREVIATIONS, PACK_WORDS, QUANTITY_PATTERN, REWRITES, STOPWORDS, UNITS

#: Letters and digits of all scripts; the same class works in SQL engines that know no Unicode \w.
WORD = r"[\p{L}\p{N}]"

#: Hangul syllables, which decompose by arithmetic.
HANGUL, HANGUL_END, VOWELS, TAILS = 0xAC00, 0xD7A3, 21, 28
PAGE = 256


@cache
def _foldings() -> tuple[str, str, dict[int, str]]:
    """What compatibility decomposition without combining marks makes of single characters, Hangul aside: characters that
    become another one, followed by those that vanish; the others in their order; and code points that become several."""
    source, target, gone, longer = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if HANGUL <= code <= HANGUL_END or not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            gone.append(c)
        elif len(plain) == 1 and plain != c:
            source.append(c)
            target.append(plain)
        elif len(plain) > 1:
            longer[code] = plain
    return "".join(source + gone), "".join(target), longer


def _ranges(codes) -> str:
    """A character class of code points."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def _listed(values) -> Column:
    """An array of strings, as one literal once the plan is made."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _in_parts(c: Column) -> Column:
    """The decomposition of a character that becomes several, by a table of pages; null for others."""
    longer = _foldings()[2]
    pages = sorted({code // PAGE for code in longer})
    number = {page: str(i) for i, page in enumerate(pages)}
    page_of = _listed([number.get(page, "-1") for page in range(pages[-1] + 1)]).cast("array<int>")
    parts = _listed([longer.get(page * PAGE + low, "") for page in pages for low in range(PAGE)])
    code = F.ascii(c)  # the code point
    page = F.get(page_of, F.shiftright(code, 8))
    found = F.nullif(F.get(parts, F.when(page >= 0, page * PAGE + code.bitwiseAND(F.lit(PAGE - 1)))), F.lit(""))
    at = code - HANGUL
    lead, vowel, tail = (_listed([chr(0x1100 + i) for i in range(19)]), _listed([chr(0x1161 + i) for i in range(VOWELS)]), _listed(["", *(chr(0x11A8 + i) for i in range(TAILS - 1))]))
    per_lead = VOWELS * TAILS
    syllable = F.concat(
        F.get(lead, ((at - at % per_lead) / per_lead).cast("int")), F.get(vowel, ((at % per_lead - at % TAILS) / TAILS).cast("int")), F.get(tail, at % TAILS)
    )
    return F.when(code.between(HANGUL, HANGUL_END), syllable).otherwise(found)


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks, of all of Unicode."""
    source, target, longer = _foldings()
    several = _ranges([*longer, *range(HANGUL, HANGUL_END + 1)])
    long = F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(_in_parts(c), c)), "")
    whole = F.when(col.rlike(several), long).otherwise(col)
    return F.when(F.length(col) == F.octet_length(col), col).otherwise(F.translate(whole, source, target))


def rewritten(col: Column) -> Column:
    """The string rewrites of the normaliser, in order, up to single tokens between white space."""
    t = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    for pattern, by, follows in REWRITES:
        unicode = "(?U)" if r"\b" in pattern else ""
        t = F.regexp_replace(t, unicode + pattern + (f"(?={follows})" if follows else ""), by.replace("\\", "$"))
    return t


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def normal_form(rewrites: Column, keep_counts: bool = False) -> Column:
    """Units, pack words, abbreviations and stop words of rewritten text, tokens between blanks.

    Every token gets a blank of its own on both sides, so each rule is one search over the text.  Numbers are glued to
    their units first; a unit after a number is used up by it, and no rule can put a number before a unit again, since
    counts go last."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(rewrites, r"\s+", " ")), " ", "  "), F.lit(" "))
    number = r" (\d+)(?:\.0+|(\.\d*[1-9])0*)?  "
    numbered = t
    spelled: dict[str, list[str]] = {}
    for word, unit in UNITS.items():
        spelled.setdefault(unit, []).append(word)
    for unit in sorted(spelled, key=lambda u: u == ""):
        by = f" $1$2{unit} " if unit else " $1$2un " if keep_counts else ""
        numbered = F.regexp_replace(numbered, number + _any(spelled[unit]) + " ", by)
    t = F.when(t.rlike(r"\d  [a-z]"), numbered).otherwise(t)
    t = F.regexp_replace(t, f" {_any([*PACK_WORDS, *spelled['']])} ", "")
    full = t
    for short, word in ABBREVIATIONS.items():
        full = F.replace(full, F.lit(f" {short} "), F.lit(f" {word} "))
    t = F.when(t.rlike(f" {_any(ABBREVIATIONS)} "), full).otherwise(t)
    return F.trim(F.regexp_replace(F.regexp_replace(t, f" {_any(STOPWORDS)} ", ""), " +", " "))


def with_normalised(df: DataFrame, text: str, out: str = "doc", keep_counts: bool = False) -> DataFrame:
    """df with the normal form of column text.  The rewrites are a column of their own, so they are made once."""
    return df.withColumn("_parts", rewritten(F.col(text))).withColumn(out, normal_form(F.col("_parts"), keep_counts)).drop("_parts")


def with_tokens(df: DataFrame, text: str, out: str = "tokens", keep_counts: bool = False) -> DataFrame:
    """df with the normalised tokens of column text."""
    return with_normalised(df, text, "_doc", keep_counts).withColumn(out, F.filter(F.split("_doc", " "), lambda x: x != "")).drop("_doc")


def quantities(normalised: Column) -> Column:
    """The set of quantity tokens of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(normalised, F.lit(QUANTITY_PATTERN), F.lit(0)))


def simple_tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD + "+"), F.lit(0))


def word_terms(normalised: Column) -> Column:
    """Words of two characters or more."""
    return F.regexp_extract_all(normalised, F.lit(WORD.replace("]", "_]") + "{2,}"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """Words, then pairs of neighbours joined by a blank."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def char_wb(normalised: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by blanks; a padded word no longer than n is one n-gram, and its last."""
    words = F.filter(F.split(normalised, r"\s+"), lambda w: w != "")

    def cut(padded: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - F.lit(n - 1)), lambda i: F.substring(padded, i, F.lit(n)))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        found = F.array().cast("array<string>")
        for n in range(low, high + 1):
            # At n the word is whole; beyond, an earlier n has given it already.
            found = F.concat(found, F.when(size >= n, cut(padded, n)).when(F.lit(n == low), F.array(padded)).otherwise(F.array().cast("array<string>")))
        return found

    return F.flatten(F.transform(words, grams))
