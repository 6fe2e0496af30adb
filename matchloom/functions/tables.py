"""Fixed values of the retail normaliser: results depend on these lists as they stand."""

STOPWORDS = (
    "de", "do", "da", "dos", "das", "e", "o", "a", "os", "as",
    "um", "uma", "para", "por", "em", "no", "na", "nos", "nas", "ao", "com",
)

ABBREVIATIONS = {
    "cerv": "cerveja",
    "refri": "refrigerante",
    "refrig": "refrigerante",
    "choc": "chocolate",
    "achoc": "achocolatado",
    "bisc": "biscoito",
    "marg": "margarina",
    "maion": "maionese",
    "shamp": "shampoo",
    "energ": "energetico",
    "grf": "garrafa",
    "lt": "lata",
}

#: Unit spellings to canonical units; the empty unit counts pieces.
UNITS = {
    "l": "l", "lt": "l", "lts": "l", "litro": "l", "litros": "l", "ltr": "l",
    "ml": "ml", "mls": "ml",
    "g": "g", "gr": "g", "grs": "g", "grama": "g", "gramas": "g",
    "kg": "kg", "kgs": "kg", "quilo": "kg", "kilo": "kg",
    "mg": "mg",
    "un": "", "und": "", "unid": "", "unidade": "", "unidades": "", "u": "",
}

PACK_WORDS = ("cx", "fd", "pct", "dz", "fardo", "caixa")

#: The normaliser's rewrites; their order is part of the result.  Each is a pattern, what takes its place (\\1: the first
#: group), and the class of what must follow.
REWRITES = (
    (r"\bs/\s*", "sem ", "[a-z]"),
    (r"\bc/\s*", "com ", "[a-z]"),
    (r"\bc[/\-]?\d+\b", " ", ""),
    (r"\b\d+\s*x\s*(\d+)", r" \1", ""),
    (r"\b(cx|fd|pct|dz)\s*\d+\b", " ", ""),
    (r"(\d+)[\.,](\d+)", r"\1.\2", ""),
    (r"(\d+(?:\.\d+)?)\s*([a-z]+)", r"\1 \2", ""),
    (r"[^a-z0-9.\s]", " ", ""),
)

QUANTITY_PATTERN = r"\d+(?:\.\d+)?(?:ml|l|g|kg|mg)\b"
PACK_TOKEN_PATTERN = r"C/\d+|\d+X\d+\w*|CX\d*|FD\d*|PCT|UND?|UNID"

NO_MATCH_PROBES = (
    "MORMAII LATA BRANCO C/6",
    "Limpador para Casa Perfumado QUALITÁ Lavanda 2 litros",
    "Farinha de Chia Taeq Pouch 150g",
    "Rabo de Bovino Congelado SWIFT 2Kg",
    "Ração para Cães Carnilove Adulto Fresh Chicken & Rabbit 1,5kg",
    "CACHACA COBICADA UMBURANA 250ml C/6",
    "CHICLETE BUZZY ROSA MORANGO",
)
CONTROL_PROBES = (
    "Café Solúvel Granulado Forte Nescafé Tradição Sachê 40g",
    "Lava-Roupas Líquido Lavanda Omo Sachê 900ml Refil",
)

THRESHOLDS = (0.45, 0.55, 0.65)

#: Diagnoses of a wrong first match.
WRONG_SIZE = "tamanho/quantidade errada"
WRONG_VARIANT = "variante/sabor/versão errada do mesmo produto"
OTHER_PRODUCT = "produto diferente (similaridade lexical enganosa)"
