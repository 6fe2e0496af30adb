"""Operator 4: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes "▁" + text with blanks as "▁", and is cut before every "▁" that follows another character: no piece of
the vocabulary crosses such a cut (checked when the tables are built; otherwise a text is one word).  Distinct words
are encoded together, cut further into segments wherever two characters meet that meet in no piece: no merge can cross
there, and so long words fall apart.  The symbols lie in one flat numpy array; a round looks up the rank of every
adjacent pair, takes each segment's minimum by a segmented reduction, merges the leftmost pairs of that rank in all
segments at once and compacts the array, until no pair is left.  Where a merge gives a pair of no worse rank than its
own with what stands beside it then, the pairs to its right in that segment wait for the next round, as they would in
a priority queue.  Characters outside the vocabulary fall back to bytes.

Null texts count as empty ones, whose ids are the end id alone.  Texts are encoded whole.  Words already met are kept
in a bounded table per Python worker; a lost executor loses only that.  Repeated rows give equal results, an empty
table an empty one; extra columns are carried along by encoded().
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm.common import Sent, arrow_map, table

BLANK = "▁"
NONE = np.iinfo(np.int32).max
#: Words kept per worker, and characters of one round of new words.
KEPT_WORDS = 400_000
ROUND_CHARS = 400_000


@dataclass
class Tables:
    """What encoding needs of a model, as arrays."""

    surfaces: list  # by id: text, or None for a byte, "" for a control id
    bytes_at: int  # id of byte 0
    end_id: int
    symbols: dict  # character -> symbol
    n_symbols: int  # the vocabulary's ids, then single characters that occur in pieces only
    keys: np.ndarray  # sorted left * n_symbols + right
    merged: np.ndarray  # piece of each key
    rank: np.ndarray  # by piece
    leads: np.ndarray  # by piece: it is part of a merge of no worse rank than its own
    meet: np.ndarray  # sorted left * n_symbols + right of characters that meet in a piece
    cuts: bool


def tables(model_file: str) -> Tables:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(size)]
    of = {names[i]: i for i in range(size) if normal[i]}
    single = dict(of)
    for p in of:
        for c in p:
            single.setdefault(c, size + len(single) - len(of))
    scores = np.array([sp.get_score(i) if normal[i] else -np.inf for i in range(size)])
    rank = np.unique(-scores, return_inverse=True)[1]
    left, right, made = [], [], []
    for p, i in of.items():
        for k in range(1, len(p)):
            a, b = single.get(p[:k]), single.get(p[k:])
            if a is not None and b is not None and (k == 1 or a < size) and (len(p) - k == 1 or b < size):
                left.append(a)
                right.append(b)
                made.append(i)
    n = size + len(single) - len(of)
    left, right, made = (np.array(x, np.int64) for x in (left, right, made))
    leads = np.zeros(size, bool)
    for part in (left, right):
        whole = part < size
        ahead = rank[made[whole]] <= rank[part[whole]]
        leads[part[whole][ahead]] = True
    meet = {single[a] * n + single[b] for p in of for a, b in zip(p, p[1:])}
    order = np.argsort(left * n + right)
    return Tables(
        surfaces=[names[i].replace(BLANK, " ") if normal[i] else None if sp.is_byte(i) else " ⁇ " if sp.is_unknown(i) else "" for i in range(size)],
        bytes_at=sp.piece_to_id("<0x00>"),
        end_id=sp.eos_id(),
        symbols={c: s for c, s in single.items() if len(c) == 1},
        n_symbols=n,
        keys=(left * n + right)[order],
        merged=made[order].astype(np.int32),
        rank=rank.astype(np.int32),
        leads=leads,
        meet=np.array(sorted(meet), np.int64),
        cuts=not any(BLANK in p.lstrip(BLANK) for p in of),
    )


def _held(keys: np.ndarray, asked: np.ndarray):
    """Where in the sorted keys each one asked for would be, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


def _ranks(left: np.ndarray, right: np.ndarray, t: Tables) -> np.ndarray:
    at, hit = _held(t.keys, np.where((left < 0) | (right < 0), -1, left * t.n_symbols + right))
    return np.where(hit, t.rank[t.merged[at]], NONE)


def _in_turn(best: np.ndarray, piece: np.ndarray, symbol: np.ndarray, word: np.ndarray, t: Tables) -> np.ndarray:
    """Of pairs to merge in a round, those a queue would merge before any pair that they bring about."""
    made = piece[best]
    asks = np.flatnonzero(t.leads[made])
    if not len(asks):
        return best
    at, own = best[asks], made[asks]
    last = len(symbol) - 1
    # To the left stands what this round has made already, to the right what it has not reached yet.
    before = np.maximum(at - 1, 0)
    done = np.isin(at - 2, best, assume_unique=True)
    left = np.where(done, piece[np.maximum(at - 2, 0)], symbol[before])
    after = np.minimum(at + 2, last)
    near = np.minimum(
        np.where((at > 0) & (word[before] == word[at]), _ranks(left, own, t), NONE),
        np.where((at + 2 <= last) & (word[after] == word[at]), _ranks(own, symbol[after], t), NONE),
    )
    stop = at[near <= t.rank[own]]
    if not len(stop):
        return best
    words, first = np.unique(word[stop], return_index=True)
    where, held = _held(words, word[best])
    return best[~held | (best <= stop[first][where])]


def merge_rounds(words: list[str], t: Tables) -> tuple[list[list[int]], set[int]]:
    """The ids of each word, none of them empty; which words have byte ids."""
    text = "".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    distinct, inverse = np.unique(codes, return_inverse=True)
    # A character of no piece is -1 - its code: it never merges.
    ids = np.array([t.symbols.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
    symbol = ids[inverse]
    whole = np.repeat(np.arange(len(words)), lengths)
    apart = ~_held(t.meet, np.where((symbol[:-1] < 0) | (symbol[1:] < 0), -1, symbol[:-1] * t.n_symbols + symbol[1:]))[1]
    new = np.append(True, (whole[1:] != whole[:-1]) | apart)[: len(symbol)]
    whole = whole[new]  # by segment: its word
    word = np.cumsum(new) - 1
    done_symbol, done_word = [], []
    while len(symbol):
        key = symbol[:-1] * t.n_symbols + symbol[1:]
        key[(word[:-1] != word[1:]) | (symbol[:-1] < 0) | (symbol[1:] < 0)] = -1
        at, hit = _held(t.keys, key)
        piece = t.merged[at]
        rank = np.append(np.where(hit, t.rank[piece], NONE), NONE)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(symbol)))
        least_of = np.repeat(least, sizes)
        # Segments without a pair leave the array.
        over = least_of == NONE
        if over.any():
            done_symbol.append(symbol[over])
            done_word.append(word[over])
        best = np.flatnonzero((rank == least_of) & ~over)
        if not len(best):
            break
        # Of neighbouring candidates every other one, from the left.
        run = np.append(True, np.diff(best) != 1)
        place = np.arange(len(best))
        odd = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
        best = _in_turn(best[~odd], piece, symbol, word, t)
        symbol[best] = piece[best]
        stays = ~over
        stays[best + 1] = False
        symbol, word = symbol[stays], word[stays]
    symbol, word = np.concatenate(done_symbol or [symbol]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    symbol, word = symbol[order], whole[word[order]]
    starts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
    odd = set(word[(symbol < 0) | (symbol >= len(t.surfaces))].tolist())
    flat = symbol.tolist()
    out = [flat[a:b] for a, b in zip(starts, starts[1:])]
    for i in odd:
        out[i] = [x for s in out[i] for x in _plain_ids(s, t)]
    return out, odd


def _plain_ids(s: int, t: Tables) -> list[int]:
    if 0 <= s < len(t.surfaces):
        return [s]
    c = chr(-1 - s) if s < 0 else next(c for c, x in t.symbols.items() if x == s)
    return [t.bytes_at + b for b in c.encode()]


def surface(ids: list[int], t: Tables) -> str:
    """The text of ids, without regard to where they stand: byte ids gather to UTF-8, what is not becomes U+FFFD."""
    out, run = [], bytearray()
    for i in ids:
        s = t.surfaces[i]
        if s is None:
            run.append(i - t.bytes_at)
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run = bytearray()
        out.append(s)
    if run:
        out.append(run.decode("utf-8", "replace"))
    return "".join(out)


def decode(ids: list[int], t: Tables) -> str:
    """The text of ids; the blank that encoding puts first goes."""
    text = surface(ids, t)
    shown = [i for i in ids if t.surfaces[i] != ""]
    return text[1:] if shown and (t.surfaces[shown[0]] or "").startswith(" ") else text


_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def words_of(text: str, t: Tables) -> list[str]:
    if not text:
        return []
    text = BLANK + text.replace(" ", BLANK)
    if not t.cuts:
        return [text]
    parts = text.split(BLANK)
    if "" not in parts[1:]:
        return [BLANK + p for p in parts[1:]]
    return _WORDS.findall(text)


class Encoder:
    """Encodes texts; keeps number, decimals and text of the ids of words it has met."""

    def __init__(self, t: Tables):
        self.t, self.kept = t, {}
        self.decimals = [str(i) for i in range(len(t.surfaces))]

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = list(words)
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (chars < ROUND_CHARS or end == at):
                chars += len(new[end])
                end += 1
            part = new[at:end]
            every, odd = merge_rounds(part, self.t)
            decimal, piece, kept = self.decimals.__getitem__, self.t.surfaces.__getitem__, self.kept
            for i, (w, ids) in enumerate(zip(part, every)):
                decoded = surface(ids, self.t) if i in odd else "".join(map(piece, ids))
                kept[w] = (len(ids), " ".join(map(decimal, ids)), decoded)
            at = end

    def encode(self, text: str) -> list[int]:
        words = words_of(text, self.t)
        self.learn(set(words))
        return [int(i) for w in words for i in self.kept[w][1].split()]

    def digests(self, texts: list[str]):
        """For each text with the end id: number of ids, their decimals joined by blanks, the decoded text."""
        cut = [words_of(x, self.t) for x in texts]
        fresh = {w for words in cut for w in words}
        if len(fresh) > KEPT_WORDS // 2 and len(texts) > 1:  # long texts: half as many at a time
            half = len(texts) // 2
            yield from self.digests(texts[:half])
            yield from self.digests(texts[half:])
            return
        self.learn(fresh)
        end = str(self.t.end_id)
        for words in cut:
            got = [self.kept[w] for w in words]
            counts, decimals, decoded = zip(*got) if got else ((), (), ())
            # A text's first piece starts with the blank that encoding put there.
            yield sum(counts) + 1, " ".join((*decimals, end)), "".join(decoded)[1:]


def _encoder(t: dict) -> Encoder:
    # Workers may lack this package, so what is broadcast holds no class of it.
    return Encoder(Tables(**t))


def encoded(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """df with ids (array<int>), the end id last."""
    from pyspark.sql.functions import col, pandas_udf

    sent = Sent(df.sparkSession, "pieces", vars(tables(model_file)))

    @pandas_udf("array<int>")
    def ids(texts):
        e = sent.made(_encoder)
        return texts.map(lambda x: [*e.encode(x or ""), e.t.end_id])

    return df.withColumn("ids", ids(col(text)))


def digested(df: DataFrame, model_file: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    sent = Sent(df.sparkSession, "pieces", vars(tables(model_file)))

    def run(docs, texts):
        out = []
        for n, ids, decoded in sent.made(_encoder).digests([x or "" for x in texts]):
            out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return [docs, *(map(list, zip(*out)) if out else ([], [], []))]

    kind = df.schema[doc].dataType.simpleString()
    schema = f"{doc} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(df.select(doc, text), run, schema, rows=256)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digested(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
