"""Operator 7: vector bin packing of examples into sequences.

Texts are tokenised, an end id is added, and an example longer than a sequence is cut into pieces.  Every piece is a
vector of demands: tokens, one segment, loss-bearing tokens.  A sequence is filled by the dot-product heuristic: of the
pieces that fit under all three limits, the one whose demand has the largest weighted inner product with what the
sequence has left comes next; a weight is the mean demand in its dimension.  When nothing fits, the next sequence opens.

An example is one text, all of whose ids bear loss but the first, which nothing predicts; or parts in turn, of which
only the learned ones do (instruction data: prompts take room and bear none).  On plain documents loss follows tokens,
so there the loss limit binds no more than the token limit unless it is set lower.

The pieces are written once, with their ids where those are asked for.  Then numbers alone are packed: pieces are dealt
in turn to groups of GROUP_PIECES, counted beforehand, and each group is packed by one task; ids never go there, but
are joined to their places in the JVM.  The dealing counts pieces within a partition, so no key, source or long
document can overload a group.  At most one sequence of a group is left partly empty for want of pieces.

A null text counts as an empty one: its only id is the end id.  Repeated rows are packed each for itself, an empty
table gives no pieces, other columns are ignored, and null doc_ids are kept.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Sent, table, trimmed, written

#: Stretches of text whose ids a worker keeps before it starts anew, about 150 MB, and their characters at most.
KEPT_CHUNKS = 1_000_000
KEPT_CHARS = 16_000_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


#: Pieces of one packing group.
GROUP_PIECES = 2000


class Tokens:
    """Ids of texts, by a tokenizer of words with end marks to whose pattern white space is a boundary.  Stretches
    between white space are encoded once and kept, as bytes of unsigned 32-bit ids.

    New stretches of letters alone are one word each: they are encoded many at a time as one text, whose ids are cut
    after each end mark.  Should a text have more marks than stretches, its stretches are encoded one by one.  A word
    and a comma or point after it are two words for the tokenizer, unless the word's normal form ends in a mark (that of
    İ does), which joins them: such a stretch is encoded whole."""

    def __init__(self, definition: str, most: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_str(definition), {"": b""}
        self.most, self.chars = KEPT_CHUNKS if most is None else most, 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def _encode(self, texts: list[str]):
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        kept, words, rest, pointed = self.kept, set(), [], []
        for c in new:
            if c.isalpha():
                words.add(c)
            elif c[-1] in ",." and c[:-1].isalpha() and (c.isascii() or unicodedata.normalize("NFC", c[:-1]).lower()[-1].isalpha()):
                pointed.append(c)
                if c[:-1] not in kept:
                    words.add(c[:-1])
            else:
                rest.append(c)
        rest += [c for c in ",." if c not in kept]
        words = list(words)
        parts = [words[at : at + 500] for at in range(0, len(words), 500)]
        for part, ids in zip(parts, self._encode([" ".join(p) for p in parts])):
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part):
                rest += part
                continue
            flat, start = ids.tobytes(), 0
            for c, stop in zip(part, stops):
                kept[c] = flat[start:stop]
                start = stop
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for c, ids in zip(part, self._encode(part)):
                kept[c] = ids.tobytes()
        for c in pointed:
            kept[c] = kept[c[:-1]] + kept[c[-1]]

    def of(self, texts: list[str]) -> list[bytes]:
        cut, fresh = [], set()
        for t in texts:
            for space in "\t\n\x0b\x0c\r":
                if space in t:
                    t = t.replace(space, " ")
            cut.append(t.split(" "))
            fresh.update(cut[-1])
        new = fresh.difference(self.kept)
        chars = sum(map(len, new))
        if len(self.kept) + 2 * len(new) > self.most or self.chars + chars > KEPT_CHARS:
            self.kept, self.chars = {"": b""}, 0
            new = fresh - {""}
            chars = sum(map(len, new))
        if new:
            self.chars += chars
            self._learn(new)
        get = self.kept.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


def placed(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The bin of each piece, by the dot-product heuristic; one piece always fits an empty bin."""
    if len(tokens) and (tokens.max() > limits.tokens or loss.max() > limits.loss or limits.segments < 1):
        raise ValueError("a piece exceeds the limits by itself")
    order = np.lexsort((np.arange(len(tokens)), -loss, -tokens))
    t, s = tokens[order].astype(float), loss[order].astype(float)
    # A demand's share of a limit, weighted by the mean demand, both in units of the limit.
    by_token = (t.mean() if len(t) else 0) / limits.tokens**2
    by_loss = (s.mean() if len(s) else 0) / limits.loss**2
    bins = np.empty(len(order), np.int64)
    where, bin_no, picked = order, 0, 0
    tokens_left, loss_left, segments_left = limits.tokens, limits.loss, limits.segments
    for _ in range(len(order)):
        while True:
            # Every piece is one segment, so that dimension decides whether any fits and not which.
            inner = np.minimum(t, limits.tokens) * (by_token * tokens_left / limits.tokens) + s * (by_loss * loss_left / limits.loss)
            inner[(t > tokens_left) | (s > loss_left)] = -1.0
            pick = int(inner.argmax())
            if segments_left and inner[pick] >= 0:
                break
            bin_no += 1
            tokens_left, loss_left, segments_left = limits.tokens, limits.loss, limits.segments
        bins[where[pick]] = bin_no
        tokens_left, loss_left, segments_left = tokens_left - t[pick], loss_left - s[pick], segments_left - 1
        t[pick] = np.inf  # taken
        picked += 1
        if picked == 128:
            rest = t < np.inf
            t, s, where, picked = t[rest], s[rest], where[rest], 0
    return bins


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, key long, turn long"


def cuts(n: int, learned: np.ndarray | None, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, end, loss) of the pieces of n ids that bear loss or not, each as long as the limits let it be; without
    learned, all but the first do."""
    if learned is None:
        if n <= min(limits.tokens, limits.loss):
            return [(0, n, n - 1)]
        learned = np.arange(n) > 0
    before = np.append(0, np.cumsum(learned))
    out, start = [], 0
    while start < n:
        end = min(start + limits.tokens, int(np.searchsorted(before, before[start] + limits.loss, "right")) - 1)
        out.append((start, end, int(before[end] - before[start])))
        start = end
    return out


def pieces(df: DataFrame, definition: str, end_id: int, limits: Limits, doc: str = "doc_id", text: str = "text", ids: bool = False, most_kept: int | None = None) -> DataFrame:
    """The pieces of every example, with a key each and its turn; with their ids on demand.  text: a string, or an
    array of structs (text, learned), the parts of an example in their order."""
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if limits.tokens < 1 or limits.loss < 1:
        raise ValueError("a sequence must have room for a token that bears loss")
    sent = Sent(df.sparkSession, "tokens", definition)
    schema = PIECES + ", ids array<int>" * ids
    target = to_arrow_schema(_parse_datatype_string(schema))
    parted = df.schema[text].dataType.typeName() == "array"

    def examples(tokens, rows):
        """Ids as bytes, and which bear loss, of each row."""
        end = np.array([end_id], "<u4").tobytes()
        if not parted:
            for b in tokens.of([x or "" for x in rows]):
                yield b + end, None
            return
        parts = [[("" if p is None else p["text"] or "", bool(p and p["learned"])) for p in x or []] for x in rows]
        flat = iter(tokens.of([t for x in parts for t, _ in x]))
        for x in parts:
            own = [next(flat) for _ in x] + [end]
            learned = np.repeat([g for _, g in x] + [x[-1][1] if x else True], [len(b) // 4 for b in own])
            learned[0] = False
            yield b"".join(own), learned

    def run(batches):
        tokens = sent.made(lambda definition: Tokens(definition, most_kept))
        at_key, turn = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() * 7919
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for d, (b, learned) in zip(part.column(0).to_pylist(), examples(tokens, part.column(1).to_pylist())):
                    for start, stop, loss in cuts(len(b) // 4, learned, limits):
                        own = b[4 * start : 4 * stop]
                        row = (d, start, stop - start, zlib.crc32(own), len(b) // 4, loss, at_key, turn)
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if ids else row)
                        at_key, turn = at_key + 1, turn + 1
                cols = list(zip(*rows)) or [[] for _ in target]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, target)], schema=target)
        trimmed()

    return df.select(F.col(doc).cast("long"), F.col(f"`{text}`")).mapInArrow(run, schema)


def packed(numbers: DataFrame, groups: int, limits: Limits = Limits()) -> DataFrame:
    """key, sequence_id and offset of every piece.  numbers: key, turn, length, loss."""
    import pyarrow as pa

    def pack(key, part):
        # A total order that does not depend on how the shuffle delivered the rows.
        part = part.sort_by("key")
        tokens, loss = (part.column(c).to_numpy().astype(np.int64) for c in ("length", "loss"))
        whole = tokens == limits.tokens
        bins = np.empty(len(tokens), np.int64)
        bins[whole] = np.arange(whole.sum())
        bins[~whole] = placed(tokens[~whole], loss[~whole], limits) + whole.sum()
        at = np.lexsort((np.arange(len(bins)), bins))
        total = np.cumsum(tokens[at])
        first = np.append(True, np.diff(bins[at]) != 0)
        offset = np.empty_like(total)
        offset[at] = total - tokens[at] - np.maximum.accumulate(np.where(first, total - tokens[at], 0))
        sequence = (np.int64(key[0].as_py()) << 32) + bins
        return pa.table({"key": part.column("key"), "sequence_id": sequence, "offset": offset})

    dealt = numbers.select("key", "length", "loss", F.pmod("turn", F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(pack, "key long, sequence_id long, offset long")


def pack_examples(df: DataFrame, tokenizer_file: str, end_id: int = 2, limits: Limits = Limits(), ids: bool = False, most_kept: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, loss, sequence_id, offset and, on demand, ids of every piece."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    cut = written(pieces(df, definition, end_id, limits, doc, text, ids, most_kept), "pieces")
    groups = max(1, math.ceil(cut.count() / GROUP_PIECES))
    places = packed(cut, groups, limits).withColumnRenamed("key", "of_key")
    return cut.join(places, F.col("key") == F.col("of_key")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "sequence_id", "offset", *["ids"] * ids
    )


def of_conversations(turns: DataFrame, learned: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """doc_id and text, the parts of each conversation in the order of its turns; the turns of one role are learned."""
    part = F.struct(F.col(turn).alias("turn"), F.col(text).alias("text"), F.coalesce(F.col(role) == learned, F.lit(False)).alias("learned"))
    whole = turns.groupBy(F.col(conv).alias("doc_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("doc_id", F.transform("parts", lambda p: F.struct(p["text"].alias("text"), p["learned"].alias("learned"))).alias("text"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_examples(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: The stage runs in workers that hold what four stages before it have left: an eighth of the operator's table.
STAGE_CHUNKS = KEPT_CHUNKS // 8


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and ids."""
    import public_tokenizers

    out = pack_examples(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True, most_kept=STAGE_CHUNKS)
    return out.drop("loss")
