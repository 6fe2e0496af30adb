"""Operator 12: byte-level BPE encoding and decoding by segment trees over adjacent pair ranks.

A text is cut where a token of the vocabulary's text is special, and the rest into words by the pattern of byte-level
tokenizers; merges stay within a word.  Over a word's adjacent pairs stands a segment tree: a leaf is the rank of its
pair with its place, a node the least of the two below it, so the root is the leftmost pair of lowest rank.  A merge
makes one symbol of that pair, takes the pair to its right out, gives both neighbours their new ranks, and mends the
three leaves' ways to the root: logarithmic updates, until the root says that no pair is left.

Words met for the first time are encoded together: short ones in forests, one tree a row of a flat array, all roots
read and all leaves updated at once; long ones one by one.  Texts are cut at single blanks between other characters
first, where every word of the pattern begins; such stretches are kept with their ids and bytes in a bounded table per
worker, and a lost executor loses only that.  Decoding joins the bytes of ids; what is not UTF-8 becomes U+FFFD.

Null texts count as empty ones and have no ids.  Texts are encoded whole, however long.  Repeated rows give equal
results, an empty table an empty one; encoded() keeps the other columns, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, arrow_map, table

# The white space and the pattern of byte-level tokenizers.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

NONE = np.iinfo(np.int64).max
#: Stretches of text that a worker keeps in each of two tables, and their characters at most.
KEPT_STRETCHES, KEPT_CHARS = 500_000, 6_000_000
#: Words of up to so many bytes are merged in forests; and bytes of one forest.
SHORT, FOREST_BYTES = 64, 1_000_000
#: Characters of texts that are encoded together.
SLICE_CHARS = 4_000_000


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in such vocabularies: visible Latin-1 ones for themselves, those from U+0100 on
    for the others in turn."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary's merges, from the definition of a tokenizer file."""

    def __init__(self, definition: str):
        import regex

        told = json.loads(definition)
        names, vocab = byte_names(), told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(PATTERN)
        # A blank that has white space beside it, or stands at an end; and the other blanks, where stretches begin.
        self.odd = re.compile(f"[{SPACES}] | [{SPACES}]|^ | $")
        self.cut = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * self.size
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(names[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])], np.int64)
        # By key of a pair: its rank and what it becomes.  Of a pair that is named twice the first rank counts.
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] * self.size + vocab[b], (rank, vocab[a + b]))
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, NONE)
        self.ranks = np.array([self.pairs[k][0] for k in keys.tolist()] + [-1], np.int64)
        self.made = np.array([self.pairs[k][1] for k in keys.tolist()] + [-1], np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1; a symbol below 0 pairs with nothing."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.made[np.searchsorted(self.keys, left * self.size + right)]


def merge_forest(words: list[bytes], m: Merges) -> list[list[int]]:
    """The ids of each word, by one segment tree a word, all of one size, updated together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    most = int(lengths.max())
    if most == 1:
        return [[i] for i in m.of_byte[np.frombuffer(b"".join(words), np.uint8)].tolist()]
    leaves = 1 << (most - 2).bit_length() if most > 2 else 1  # places of pairs
    symbol = np.full((len(words), leaves + 1), -1, np.int64)
    symbol[np.arange(leaves + 1) < lengths[:, None]] = m.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(leaves + 1)
    after = np.where(place + 1 < lengths[:, None], place + 1, leaves + 1)  # leaves + 1: nothing
    before = np.broadcast_to(place - 1, symbol.shape).copy()
    tree = np.full((len(words), 2 * leaves), NONE, np.int64)
    rank = m.ranked(symbol[:, :-1], symbol[:, 1:])
    tree[:, leaves:] = np.where(rank >= 0, rank * leaves + place[:-1], NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        at = tree[rows, 1] % leaves
        gone = after[rows, at]
        made = m.merged(symbol[rows, at], symbol[rows, gone])
        symbol[rows, at] = made
        symbol[rows, gone] = -1
        far = after[rows, gone]
        after[rows, at] = far
        near = before[rows, at]
        has_far, has_near = far <= leaves, near >= 0
        before[rows[has_far], far[has_far]] = at[has_far]
        # The pair that begins here, the one that began at the symbol that is gone, and the one that ends here.
        own = np.full(len(rows), -1, np.int64)
        own[has_far] = m.ranked(made[has_far], symbol[rows[has_far], far[has_far]])
        left = m.ranked(symbol[rows[has_near], near[has_near]], made[has_near])
        tree[rows, leaves + at] = np.where(own >= 0, own * leaves + at, NONE)
        ends = gone < leaves  # the last symbol begins no pair, and may have no leaf
        tree[rows[ends], leaves + gone[ends]] = NONE
        tree[rows[has_near], leaves + near[has_near]] = np.where(left >= 0, left * leaves + near[has_near], NONE)
        nodes = [(rows, leaves + at), (rows[ends], leaves + gone[ends]), (rows[has_near], leaves + near[has_near])]
        level = leaves
        while level > 1:
            for i, (r, node) in enumerate(nodes):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                nodes[i] = (r, node)
            level //= 2
        rows = rows[tree[rows, 1] < NONE]
    left_over = symbol >= 0
    flat, stops = symbol[left_over].tolist(), np.cumsum(left_over.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


def merge_one(word: bytes, m: Merges) -> list[int]:
    """The ids of a word, by one segment tree."""
    symbol = m.of_byte[np.frombuffer(word, np.uint8)]
    n, pairs, size = len(symbol), m.pairs, m.size
    if n < 2:
        return symbol.tolist()
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    rank = m.ranked(symbol[:-1], symbol[1:])
    level = np.full(leaves, NONE, np.int64)
    level[: n - 1] = np.where(rank >= 0, rank * leaves + np.arange(n - 1), NONE)
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [int(NONE)] + [x for level in reversed(levels) for x in level.tolist()]
    symbol, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        at += leaves
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break  # so are all above
            tree[at] = least

    def ranked(at: int) -> int:
        found = pairs.get(symbol[at] * size + symbol[after[at]]) if after[at] < n else None
        return found[0] * leaves + at if found else int(NONE)

    while tree[1] < NONE:
        at = tree[1] % leaves
        gone = after[at]
        symbol[at] = pairs[symbol[at] * size + symbol[gone]][1]
        symbol[gone] = -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        if gone < n - 1:
            put(gone, int(NONE))
        put(at, ranked(at))
        if before[at] >= 0:
            put(before[at], ranked(before[at]))
    return [s for s in symbol if s >= 0]


def merge_words(words: list[bytes], m: Merges) -> dict[bytes, list[int]]:
    """The ids of each word, none of them empty."""
    out, sizes = {}, {}
    for w in words:
        if len(w) > SHORT:
            out[w] = merge_one(w, m)
        else:
            sizes.setdefault((len(w) - 2).bit_length() if len(w) > 1 else -1, []).append(w)
    for of_size in sizes.values():
        step = max(1, FOREST_BYTES // (4 * len(max(of_size, key=len))))
        for at in range(0, len(of_size), step):
            out.update(zip(of_size[at : at + step], merge_forest(of_size[at : at + step], m)))
    return out


class Encoder:
    """Encodes texts; keeps number, decimals and bytes of the ids of the stretches it has met."""

    def __init__(self, m: Merges):
        self.m, self.kept, self.before, self.chars = m, {}, {}, 0
        self.decimals = [str(i) for i in range(m.size)]

    def stretches(self, text: str) -> list[str]:
        """text in parts, each the start of a word of the pattern; special tokens stand alone."""
        if self.m.at_special and any(s in text for s in self.m.special):
            return [s for i, part in enumerate(self.m.at_special.split(text)) for s in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        first, *rest = self.m.cut.split(text) if self.m.odd.search(text) else text.split(" ")
        return [first, *(" " + x for x in rest)]

    def _of_words(self, words: set[str]) -> dict[str, tuple]:
        as_bytes = {w: w.encode() for w in words}
        ids = merge_words(list(as_bytes.values()), self.m)
        decimal, surface, out = self.decimals.__getitem__, self.m.bytes_of.__getitem__, {}
        for w, b in as_bytes.items():
            own = ids[b]
            out[w] = (len(own), ",".join(map(decimal, own)), b"".join(map(surface, own)))
        return out

    def learn(self, new: set[str]) -> None:
        m, kept, words, several = self.m, self.kept, set(), {}
        for s in new:
            if s.isascii() and (s[1:] if s[0] == " " else s).isalpha():
                words.add(s)  # one word of the pattern, as most are
            elif s in m.special:
                kept[s] = (1, self.decimals[m.special[s]], m.bytes_of[m.special[s]])
            else:
                several[s] = m.word.findall(s)
        words.update(w for ws in several.values() for w in ws if w not in kept)
        kept.update(self._of_words(words))
        for s, ws in several.items():
            if len(ws) > 1:
                counts, decimals, parts = zip(*map(kept.__getitem__, ws))
                kept[s] = (sum(counts), ",".join(decimals), b"".join(parts))

    def _met(self, texts: list[str]) -> list[list[str]]:
        cut = [self.stretches(t) for t in texts]
        met = {s for part in cut for s in part}
        absent = met.difference(self.kept)
        if self.kept and (len(self.kept) + 2 * len(absent) > KEPT_STRETCHES or self.chars > KEPT_CHARS):
            # What is still in use comes back from the table before.
            self.before, self.kept, self.chars, absent = self.kept, {}, 0, met
        self.kept.update((s, self.before[s]) for s in absent if s in self.before)
        absent = absent.difference(self.kept)
        self.chars += sum(map(len, absent))
        self.learn(absent)
        return cut

    def encode(self, text: str) -> list[int]:
        (cut,) = self._met([text])
        return [int(i) for s in cut for i in self.kept[s][1].split(",")]

    def digests(self, texts: list[str]):
        """For each text: the number of its ids, their decimals joined by commas, the decoded text."""
        for cut in self._met(texts):
            counts, decimals, parts = zip(*map(self.kept.__getitem__, cut)) if cut else ((), (), ())
            yield sum(counts), ",".join(decimals), b"".join(parts).decode("utf-8", "replace")


def decode(ids: list[int], m: Merges) -> str:
    return b"".join(m.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _encoder(definition: str) -> Encoder:
    return Encoder(Merges(definition))


def _definition(tokenizer_file: str) -> str:
    with open(tokenizer_file, encoding="utf-8") as f:
        return f.read()


def sliced(texts: list[str]):
    """texts in runs of at most SLICE_CHARS characters, or of one text."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encoded(df: DataFrame, tokenizer_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with ids (array<int>)."""
    sent = Sent(df.sparkSession, "bpe", _definition(tokenizer_file))

    @F.pandas_udf("array<int>")
    def ids(texts):
        e = sent.made(_encoder)
        return texts.map(lambda x: e.encode(x or ""))

    return df.withColumn(out, ids(F.col(f"`{text}`")))


def decoded(df: DataFrame, tokenizer_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of ids; null ids have none."""
    sent = Sent(df.sparkSession, "bpe", _definition(tokenizer_file))

    @F.pandas_udf("string")
    def texts(every):
        e = sent.made(_encoder)
        return every.map(lambda x: None if x is None else decode([i for i in x if i is not None], e.m))

    return df.withColumn(out, texts(F.col(f"`{ids}`")))


def digested(df: DataFrame, tokenizer_file: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    sent = Sent(df.sparkSession, "bpe", _definition(tokenizer_file))

    def run(docs, texts):
        e, out = sent.made(_encoder), []
        for some in sliced([x or "" for x in texts]):
            for n, ids, plain in e.digests(some):
                out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
        return [docs, *(map(list, zip(*out)) if out else ([], [], []))]

    rows = df.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=256)


def op12_bpe_segment_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digested(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
