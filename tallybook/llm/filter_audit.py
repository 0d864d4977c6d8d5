"""Filter interaction audit: what five quality filters remove, alone and in every order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The filters by letter; bit i of a document's mask is set if it fails filter i.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

# The transducer's tables. A byte's class selects the next state and, with the state before, what is put out.
SPACE, CAPITAL, SYMBOL, LETTER, INSIDE, BORDER = range(6)
OUTSIDE_WORD, INSIDE_WORD = 0, 1
STARTS, ENDS, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8, 16


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, the state after each class, and the output of each (state before, class).

    Bytes 0x80 to 0xBF go on with a code point. BORDER, which no byte has, stands between documents: it ends a word.
    """
    classes = np.full(256, LETTER, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[list(b"#$%&*|")] = SYMBOL
    classes[0x80:0xC0] = INSIDE
    follows = np.full(6, INSIDE_WORD, np.uint8)
    follows[[SPACE, BORDER]] = OUTSIDE_WORD
    puts = np.zeros((2, 6), np.uint8)
    puts[:, [SPACE, CAPITAL, SYMBOL, LETTER]] |= IS_POINT
    puts[:, CAPITAL] |= IS_CAPITAL
    puts[:, SYMBOL] |= IS_SYMBOL
    puts[OUTSIDE_WORD, follows == INSIDE_WORD] |= STARTS
    puts[INSIDE_WORD, follows == OUTSIDE_WORD] |= ENDS
    return classes, follows, puts


CLASSES, FOLLOWS, PUTS = tables()
#: Bytes that are hashed and compared as columns of eight; the rest of a longer word is compared as it is.
WIDE = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Bytes at to at + 8 of each word as one number; what lies behind the word's end is zero. data ends in eight bytes more."""
    numbers = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[starts + at]
    spare = (8 * np.clip(8 - (sizes - at), 0, 7)).astype(np.uint64)
    return (numbers << spare) >> spare


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A hash of each word's first WIDE bytes, its length and its document."""
    out = (seed * MIX) ^ sizes.astype(np.uint64)
    for at in range(0, WIDE, 8):
        some = np.flatnonzero(sizes > at)
        if not len(some):
            break
        mixed = (out[some] ^ _eights(data, starts[some], sizes[some], at)) * MIX
        out[some] = mixed ^ (mixed >> np.uint64(29))
    return out


def _same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes of word one and of word other are the same, pair by pair; sizes of a pair are equal."""
    same = np.ones(len(one), bool)
    for at in range(0, WIDE, 8):
        some = np.flatnonzero(same & (sizes[one] > at))
        if not len(some):
            break
        a, b = one[some], other[some]
        same[some] = _eights(data, starts[a], sizes[a], at) == _eights(data, starts[b], sizes[b], at)
    for k in np.flatnonzero(same & (sizes[one] > WIDE)).tolist():
        a, b, size = int(starts[one[k]]), int(starts[other[k]]), int(sizes[one[k]])
        same[k] = data[a : a + size].tobytes() == data[b : b + size].tobytes()
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many different words each document has: words are put into one open-addressed table, slot after slot, and
    a word counts as known only where document, length and bytes are those of the slot's word."""
    count = np.zeros(docs, np.int64)
    if not len(starts):
        return count
    slots = 1 << int(2 * len(starts)).bit_length()
    table = np.full(slots, -1, np.int64)
    hashes = _hashed(data, starts, sizes, doc.astype(np.uint64))
    at = (hashes >> np.uint64(8)).astype(np.int64) & (slots - 1)
    open_words = np.arange(len(starts))
    while len(open_words):
        slot = at[open_words]
        free = table[slot] < 0
        table[slot[free]] = open_words[free]  # of words that want one free slot the last has it
        holder = table[slot]
        mine = holder == open_words
        count += np.bincount(doc[open_words[mine]], minlength=docs)
        rest, holder = open_words[~mine], holder[~mine]
        like = (hashes[rest] == hashes[holder]) & (sizes[rest] == sizes[holder]) & (doc[rest] == doc[holder])
        known = np.zeros(len(rest), bool)
        known[like] = _same(data, starts, sizes, rest[like], holder[like])
        open_words = rest[~known]
        at[open_words] = (at[open_words] + 1) & (slots - 1)
    return count


def transduced(texts: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points (code points) and symbols of each text, by one pass over all bytes.

    The next state follows from the byte's class alone, so the states before are the states after, one byte later, and
    the pass is a few table look-ups over the whole array.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join(texts) + bytes(9), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    classes = CLASSES[data[: ends[-1] + 1]] if len(texts) else np.zeros(0, np.uint8)
    classes[ends] = BORDER
    before = np.zeros(len(classes), np.uint8)
    before[1:] = FOLLOWS[classes[:-1]]
    out = PUTS[before, classes]
    starts, stops = np.flatnonzero(out & STARTS), np.flatnonzero(out & ENDS)
    doc = np.searchsorted(ends, starts)

    def counted(kind: int) -> np.ndarray:
        return np.add.reduceat((out & kind) > 0, begins, dtype=np.int64)

    return {
        "words": np.bincount(doc, minlength=len(texts)),
        "distinct": distinct_words(data, starts, stops - starts, doc, len(texts)),
        "capitals": counted(IS_CAPITAL),
        "points": counted(IS_POINT),
        "symbols": counted(IS_SYMBOL),
    }


#: Texts are measured together up to so many bytes; a longer text is measured alone.
TOGETHER = 1 << 22
MEASURES = ("words", "distinct", "capitals", "points", "symbols")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept = batch["text"], [c for c in batch.schema.names if c != "text"]
        group, size, first = [], 0, 0
        for i in range(batch.num_rows + 1):
            text = texts[i].as_py() if i < batch.num_rows else b""
            if group and (i == batch.num_rows or size + len(text) > TOGETHER):
                found = transduced(group)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(first, len(group)) for c in kept), *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*kept, *MEASURES])
                group, size, first = [], 0, i
            group.append(text)
            size += len(text)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask of every row: bit i is set if its whole text fails filter i.

    Filter E asks for the least id of each text's SHA-256, of which a task sends one row at most to the shuffle; rows
    find it in a join whose hot digests adaptive execution splits. A row of null id has no smaller one and passes E.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), part.alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "least")
    measured = rows.mapInArrow(_measure, "doc_id long, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES))
    fails = (
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"),
        F.col("symbols") > 0,
        F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)),
    )
    mask = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return measured.join(least, "digest", "left").select("doc_id", "part", mask.alias("mask"))


def _steps() -> Column:
    """The 120 orders and their 5 steps as one constant array: order, step, bit of the filter, bits of the filters before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        rows += [f"{{'o':'{name}','s':{k + 1},'f':{1 << i},'b':{sum(1 << j for j in order[:k])}}}" for k, i in enumerate(order)]
    return F.from_json(F.lit(f"[{','.join(rows)}]"), "array<struct<o:string,s:int,f:int,b:int>>", {"allowSingleQuotes": "true"})


def audit(masks: DataFrame) -> DataFrame:
    """The counts of every part, order and step, from a table of part, mask, good and toxic (true or false).

    All follows from how many documents of a part have each mask: 128 counts a part at most, whatever the table's size.
    A filter is the first to remove a document in 120 / k of the orders if the document fails k filters.
    """
    tally = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    rows = tally.withColumn("at", F.explode(_steps())).select("part", "mask", "good", "toxic", "n", "at.*")
    fails, passed = F.col("mask").bitwiseAND(F.col("f")) != 0, F.col("mask").bitwiseAND(F.col("b")) == 0
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    share = F.expr("CAST(120 div greatest(bit_count(mask), 1) AS BIGINT)")
    return rows.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        count(passed & ~fails).alias("kept"),
        count(passed & fails).alias("removed"),
        count(~passed & fails).alias("redundant"),
        count(F.col("mask") == F.col("f")).alias("unique_fails"),
        count(passed & fails & F.col("good")).alias("good_lost"),
        count(passed & fails & F.col("toxic")).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * share)), F.lit(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order (all 120) and step (1 to 5), zeros included: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A text fails A with fewer than 100 words, B if fewer than 80 % of its words are different, C if more than 10 % of its
    code points are A to Z, D if it holds one of #$%&*|, E if a row of smaller id has the very same text. labels: doc_id,
    quality, toxic; a document is good or toxic if any of its label rows says 1, and neither without one.

    Null and empty texts have no words: they fail A, and E if a smaller id is empty too. A null part counts as an empty
    string. Rows of null id are counted, pass E, and have no label; repeated rows count each, and do not make each other
    fail E. A word may be as long as its text. Other columns stay behind. An empty table gives an empty result.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.where("labelled is not null").groupBy("labelled").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = failure_masks(docs, id_col, text_col, part_col).join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return audit(found.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
