"""Packing token sequences into fixed windows by non-negative least squares over length combinations.

Every document is cut into full windows and one remainder. The histogram of the remainders' lengths, which has as many
bins as the window has tokens, is all that the driver sees beside the counts of the parts in which ranks are counted. Combinations of two and three lengths that fill a window
exactly are its columns; non-negative least squares chooses how often each is repeated, the counts are rounded and
clipped to what the histogram has, and what is left is laid end to end and cut at window borders, largest first.
A remainder's place follows from its length and its rank among those of that length, so placing them needs no more
than a rank and a lookup in the plan, whose size depends on the window alone.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm.common import id_and_text, stored

#: Words whose ids a Python worker remembers, and texts that it tokenises at once.
REMEMBERED, BATCH = 1_000_000, 128
#: Pieces of one length whose ranks are counted together, at least, and parts in which they are, about, at most; a length
#: that more pieces have is dealt out over several.
RANKED, PARTS = 2000, 100_000
#: What the shortcut by words stands on: the tokenizer's normaliser and the way it splits texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Letters that stay letters, each by itself, when they are composed and made small: Latin but for the I with a dot
#: above, whose small form ends in a mark that joins marks behind it, and Cyrillic.
LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481]+")


@lru_cache(2)
def load(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


def by_words(tokenizer: Tokenizer) -> bool:
    """Whether texts may be taken word by word: the normaliser and the split are the known ones."""
    made = json.loads(tokenizer.to_str())
    return made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]} and made["post_processor"] is None


#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for code points from 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Words:
    """Ids of texts by their white-space-delimited words, each tokenised once while it is remembered.

    The tokenizer drops white space and lets no token cross it, and it folds case; so a text's ids are its words' ids
    in order. Bytes are used, as their lower() folds ASCII letters only and their split() parts at ASCII white space.
    A word of LETTERS with marks behind is its letters and its marks. Letters go straight to the merges, in the
    byte-level alphabet; all else goes through the whole tokenizer. Texts in which a special token's name occurs, in
    any letter case, go through it as they are; so do all texts if its normaliser or its split is another.
    """

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = load(vocabulary)
        self.merges = self.tokenizer.model.tokenize
        self.known_split = by_words(self.tokenizer)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: bytes) -> bytes:
        text = word.decode()
        if not LETTERS.fullmatch(text):
            return self.whole(text)
        ids = [t.id for t in self.merges(text if text.isascii() else "".join(map(ALPHABET.__getitem__, text.lower().encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[bytes]) -> None:
        if len(self.ids) + len(words) > REMEMBERED:
            self.ids = {}
        known = self.ids
        for word in words.difference(known):
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and LETTERS.fullmatch(stem.decode()):
                for part in (stem, marks := word[len(stem) :]):
                    if part not in known:
                        known[part] = self.encode_word(part)
                known[word] = known[stem] + known[marks]
            else:
                known[word] = self.encode_word(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        lowered = [t.encode().lower() for t in texts]
        split = [None if not self.known_split or any(name in raw for name in self.special) else raw.split() for raw in lowered]
        self.learn(set().union(*filter(None, split)))
        known = self.ids.__getitem__
        return [self.whole(text) if words is None else b"".join(map(known, words)) for text, words in zip(texts, split, strict=True)]


@lru_cache(2)
def words_of(vocabulary: str) -> Words:
    return Words(vocabulary)


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, dealt long"


def cut_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """Rows of PIECE: each document's full windows, without ids, and its remainder with ids (unsigned 32-bit, packed).

    dealt numbers the pieces of a task; once written, it tells equal pieces apart.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_of(vocabulary), np.array([end_id], "<u4").tobytes()
        dealt = count(TaskContext.get().partitionId() << 40)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch, rows = whole.slice(at, BATCH), []
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"].to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        n = len(piece) // 4
                        rows.append((doc_id, start, n, zlib.crc32(piece), total, None if n == window else zlib.compress(piece, 1), next(dealt)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "dealt"])

    return docs.mapInArrow(cut, PIECE)


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Pairs and triples (0 as third) of the given lengths, in descending order, that fill the window exactly."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = False
    first = lengths[2 * lengths >= window]
    pairs = [(a, window - a, 0) for a in first.tolist() if a < window and have[window - a]]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c > 0)
    fits[fits] = have[c[fits]]
    return np.concatenate([np.array(pairs, np.int64).reshape(-1, 3), np.stack([a[fits], b[fits], c[fits]], 1)])


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that brings the combinations' use of each length near the histogram, by least squares.

    Multiplicative updates: x stays non-negative, and each round lowers the squared difference.
    """
    window = len(histogram) - 1

    def used(x: np.ndarray) -> np.ndarray:
        found = sum(np.bincount(combos[:, i], x, window + 1) for i in range(3))
        found[0] = 0
        return found

    def back(y: np.ndarray) -> np.ndarray:
        return sum(np.where(combos[:, i] > 0, y[combos[:, i]], 0) for i in range(3))

    goal = back(histogram.astype(float))
    x = goal / max(1, len(combos))
    for _ in range(rounds):
        x *= goal / np.maximum(back(used(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Where remainders go: rows sorted by (length, first rank), and the start of what is left of each length."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    placed: np.ndarray
    left_at: np.ndarray
    sequences: int


def make_plan(histogram: np.ndarray) -> Plan:
    """Round the solution down to what the histogram has; the fullest combinations first."""
    window, free = len(histogram) - 1, histogram.astype(np.int64).copy()
    free[0] = 0
    placed, rows, sequences = np.zeros(window + 1, np.int64), [], 0
    combos = combinations(window, np.flatnonzero(free))
    if len(combos):
        x = repeat_counts(combos, free)
        for exact in (True, False):  # the rounded solution, then as many more repeats as the rest allows
            usable = (free[combos] > 0).sum(1) == (combos > 0).sum(1)
            tried = np.flatnonzero(usable & ((x >= 0.5) | (not exact)))
            for k in tried[np.argsort(-x[tried], kind="stable")].tolist():
                if any(free[i] == 0 for i in combos[k].tolist() if i):
                    continue
                lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
                most = int((free[lengths] // times).min())
                n = min(most, int(np.rint(x[k]))) if exact else most
                if n:
                    offset = 0
                    for length, m in sorted(zip(lengths.tolist(), times.tolist()), reverse=True):
                        rows.append((length, int(placed[length]), m, sequences, offset))
                        placed[length] += m * n
                        free[length] -= m * n
                        offset += m * length
                    sequences += n
    order = np.arange(window, 0, -1)
    left_at = np.zeros(window + 1, np.int64)
    left_at[order] = np.cumsum(free[order] * order) - free[order] * order
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(table[:, i] for i in range(5)), placed, left_at, sequences)


def place(plan: Plan, window: int, length: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(row, start, length, sequence, offset) of the pieces of remainders; those laid end to end may fall in two parts."""
    out, rows = [], np.arange(len(length))
    is_placed = rank < plan.placed[length]
    i, wide = rows[is_placed], int(plan.first.max(initial=0)) + 2
    at = np.searchsorted(plan.length * wide + plan.first, length[i] * wide + np.minimum(rank[i], wide - 1), "right") - 1
    within = rank[i] - plan.first[at]
    out.append((i, np.zeros(len(i), np.int64), length[i], plan.sequence[at] + within // plan.each[at], plan.offset[at] + within % plan.each[at] * length[i]))
    i = rows[~is_placed]
    begin = plan.left_at[length[i]] + (rank[i] - plan.placed[length[i]]) * length[i]
    sequence, offset = plan.sequences + begin // window, begin % window
    head = np.minimum(length[i], window - offset)
    out.append((i, np.zeros(len(i), np.int64), head, sequence, offset))
    more = head < length[i]
    out.append((i[more], head[more], length[i][more] - head[more], sequence[more] + 1, np.zeros(more.sum(), np.int64)))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, in sequences of `window` tokens.

    A document's tokens are its ids and end_id. Null and empty texts have end_id alone. Every token lies in exactly one
    piece and every sequence but the last is full. Repeated rows are packed as often as they come, null ids keep their
    tokens, an empty table gives an empty result. Ids are those that the tokenizer gives the whole text, names of
    special tokens included. The cut documents are written to the shared folder, because the histogram and the
    placement both read them; texts are tokenised once. Ranks within a length are counted in parts of RANKED pieces,
    or of a PARTS-th of all, however many pieces have it.
    """
    pieces = stored(cut_documents(id_and_text(docs, id_col, text_col), vocabulary, window, end_id))
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # window rows at most
        histogram[row["length"]] = row["count"]
    salts = np.maximum(1, -(-histogram // max(RANKED, int(histogram.sum()) // PARTS)))
    salt = F.pmod(F.xxhash64("dealt"), F.get(F.lit(salts.tolist()).cast("array<bigint>"), F.col("length"))).alias("salt")
    counts = pieces.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n")).toPandas()  # window + PARTS rows at most
    first = np.cumsum(salts) - salts
    table = np.zeros(salts.sum(), np.int64)
    table[first[counts["length"]] + counts["salt"]] = counts["n"]
    before = np.cumsum(table) - table
    before -= np.repeat(before[first], salts)
    full, histogram[window] = int(histogram[window]), 0
    plan = make_plan(histogram)

    ranked = pieces.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "dealt")) - 1).drop("dealt")
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b[c].to_numpy().astype(np.int64) for c in ("length", "rank"))
            rank = rank + before[first[length] + b["salt"].to_numpy()]
            whole = np.flatnonzero(length == window)
            parts = [(whole, np.zeros(len(whole), np.int64), length[whole], rank[whole], np.zeros(len(whole), np.int64))]
            rest = np.flatnonzero(length < window)
            parts += [(rest[i], s, n, full + q, o) for i, s, n, q, o in place(plan, window, length[rest], rank[rest])]
            for i, start, n, sequence, offset in parts:
                some, crc = b.take(pa.array(i)), b["ids_crc32"].to_numpy()[i].copy()
                for k in np.flatnonzero(n < length[i]).tolist():
                    crc[k] = zlib.crc32(zlib.decompress(some["ids"][k].as_py())[4 * start[k] : 4 * (start[k] + n[k])])
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(some["start"].to_numpy() + start), pa.array(n), pa.array(crc), some["doc_tokens"], pa.array(sequence), pa.array(offset)], fields)

    return ranked.mapInArrow(assign, ", ".join(f"{c} long" for c in fields))
