from matchloom.functions import text as T
from pyspark.sql import functions as F

GOLDEN = [
    ("COCA COLA 1L C/6", "coca cola 1l"),
    ("SKOL LATA 350ml C/12", "skol lata 350ml"),
    ("FANTA LARANJA 2L C/6", "fanta laranja 2l"),
    ("MONSTER BRANCO S/ACUCAR C/6 UNID", "monster branco sem acucar"),
    ("FINI MINI BANANAS 12X15 GR Und", "fini mini bananas 15g"),
    ("Refrigerante guaraná antarctica 200ml", "refrigerante guarana antarctica 200ml"),
    ("Suco de uva orgânico aliança 1 litro", "suco uva organico alianca 1l"),
    ("CERV HEINEKEN LONG NECK 330ML CX24", "cerveja heineken long neck 330ml"),
    ("Água mineral sem gás prata 300ml", "agua mineral sem gas prata 300ml"),
    ("LEITE COND ITALAC 395G", "leite cond italac 395g"),
    ("1,5L AGUA C/ GAS", "1.5l agua gas"),
    ("2.0 L", "2l"),
    ("10,50 kg", "10.5kg"),
    ("1.000g", "1g"),
    ("LT", "lata"),
    ("269 LT", "269l"),
    ("Saco 31x27cm", "saco 27 cm"),
    ("Água C/ 6", "agua c 6"),
    ("Nissin U.F.O. 97g", "nissin u.f.o. 97g"),
    ("7UP 2L", "7 up 2l"),
    ("Fralda G 128 Unidades", "fralda g"),
    ("cx 350ml", "350ml"),
    ("12 - x - 6", "12 x 6"),
    ("½ kg", "1 2kg"),
    ("", ""),
    ("   ", ""),
    ("6 un", ""),
    (None, ""),
    ("10 l", "10l"),
    ("1.50 l", "1.5l"),
]


def test_golden_normaliser(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.doc for r in T.with_normalised(df, "t").collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [e for _, e in GOLDEN]


def test_keep_counts(spark):
    df = spark.createDataFrame([("Fralda G 128 Unidades",)], "t string")
    assert T.with_normalised(df, "t", keep_counts=True).first().doc == "fralda g 128un"


def test_quantities(spark):
    df = spark.createDataFrame([("suco 1.5l 200ml 1.5l 3kg",)], "t string")
    assert sorted(df.select(T.quantities(F.col("t")).alias("q")).first().q) == ["1.5l", "200ml", "3kg"]


def char_wb_plain(text, low, high):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in range(low, high + 1):
            if len(w) <= n:
                if n == low or len(w) == n:
                    out.append(w)
                if len(w) < n or n == low:
                    break
                continue
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def test_char_wb(spark):
    texts = ["a", "ab", "abc", "abcd uva 1.5l", "", "refrigerante de uva"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted(r.g) for r in df.select("t", T.char_wb(F.col("t")).alias("g")).collect()]
    assert got == [sorted(char_wb_plain(t, 3, 5)) for t in texts]


def test_bigrams(spark):
    df = spark.createDataFrame([("uva",), ("suco de uva",), ("",)], "t string")
    got = [r.g for r in df.select(T.with_bigrams(T.word_terms(F.col("t"))).alias("g")).collect()]
    assert got == [["uva"], ["suco", "de", "uva", "suco de", "de uva"], []]


def test_every_character_decomposes(spark):
    import unicodedata

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    step = 64
    texts = [" ".join(map(chr, codes[i : i + step])) for i in range(0, len(codes), step)] + ["abc", "", "q\u0307\u0323 \ud55c\uae00 5\u338f \u2460\u24b6"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.s for r in df.select("i", T.strip_accents(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), (i, t)


def normal_plain(text, keep_counts=False):
    """The rules token by token."""
    import re

    from matchloom.functions.tables import ABBREVIATIONS, PACK_WORDS, STOPWORDS, UNITS

    parts, out, i = text.split(), [], 0
    while i < len(parts):
        tok = parts[i]
        i += 1
        if re.fullmatch(r"\d+(\.\d+)?", tok) and i < len(parts) and parts[i] in UNITS:
            short = tok.rstrip("0").rstrip(".") if "." in tok else tok
            unit = UNITS[parts[i]] or ("un" if keep_counts else "")
            out += [short + unit] * bool(unit)
            i += 1
        elif tok not in PACK_WORDS and UNITS.get(tok) != "" and ABBREVIATIONS.get(tok, tok) not in STOPWORDS:
            out.append(ABBREVIATIONS.get(tok, tok))
    return " ".join(out)


def test_tokens_by_chance(spark):
    import random

    rng = random.Random(3)
    bits = ["1", "20", "1.50", "0.0", "3.05", "1.2.3", ".", "l", "lt", "un", "und", "g", "kg", "cx", "fardo", "de", "e", "cerv", "cerv", "refri", "uva", "x", "100", "u"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "\t"]) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keep in (False, True):
        got = [r.d for r in df.select(T.normal_form(F.col("t"), keep).alias("d")).collect()]
        assert got == [normal_plain(t, keep) for t in texts]


MIXED = "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 \u6f22\u5b57 abc Ti\u1ebfng Vi\u1ec7t \u0395\u03bb\u03bb\u03ac\u03b4\u03b1 x_y 5 a"


def test_words_of_all_scripts(spark):
    import re

    import duckdb
    from matchloom.plans import sql as S

    row = spark.createDataFrame([(MIXED,)], "text string").select(T.simple_tokens(F.col("text")).alias("a"), T.word_terms(F.lower("text")).alias("b")).first()
    assert row.a == re.findall(r"[^\W_]+", MIXED.lower()) and row.b == re.findall(r"\b\w\w+\b", MIXED.lower())
    rel = duckdb.execute(f"SELECT {S.TOKENS}, {S.WORDS.format('lower(text)')} FROM (SELECT ? AS text)", [MIXED]).fetchone()
    assert (row.a, row.b) == rel
