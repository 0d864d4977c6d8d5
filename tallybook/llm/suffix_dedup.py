"""Removal of byte windows that occur earlier, by a depth-limited radix sort of suffixes over a cluster.

Suffixes are ordered through their first `depth` bytes only, most significant digit first; suffixes that are equal
then are exactly the repeated windows. The first digit is an anchor: of the `depth - GRAM + 1` grams of GRAM bytes in
a window, the one of least hash, which equal windows have at the same place. Neighbouring windows share anchors, so
the first pass deals out one hash for each anchor (about every 35 bytes) instead of every suffix, and only anchors
that occur twice go on, with the bytes of their windows, to the further passes. Those run inside a bucket of anchors:
each pass splits groups by the next DIGIT bytes, and suffixes that are alone leave.

Documents travel in compressed chunks, which are dealt out once and read by all three steps; messages between chunks
and buckets are packed arrays. Anchors that occur more than HOT times send their windows one by one to the bucket of
the window's own hash, so no bucket gathers all surroundings of a passage that much of the table shares. Equal
surroundings within a chunk are sent once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_and_text, shuffle_partitions
from tallybook.llm.shingles import mixed, powers

GRAM, DIGIT = 32, 50
HOT = 10_000
#: Bytes of a chunk, at which it is closed, and of the documents that numpy takes at once. Each chunk sends a message to
#: each bucket, so with more partitions than PARTITIONS chunks grow with them, up to LARGEST times: the number of messages
#: for a gigabyte stays what it is until there are LARGEST times as many.
CHUNK, SLICE, PARTITIONS, LARGEST = 8_000_000, 1_000_000, 256, 8
#: Buckets of windows for each shuffle partition; one bucket is in memory at a time.
SPLIT = 4
TABLE = np.random.default_rng(20240302).integers(1, 1 << 63, 256, np.uint64)
LAST = np.iinfo(np.int64).max
MESSAGE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
MESSAGE_DDL = "chunk long, bucket int, payload binary"


def packed(value: object) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 3)


def unpacked(data: bytes) -> object:
    return pickle.loads(zstandard.decompress(data))


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], MESSAGE.types[i]) for i in range(3)], schema=MESSAGE)


class Sums:
    """Polynomial hashes of any spans of data, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * up[: len(data)])])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.down[begins])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def anchors(sums: Sums, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last of the window starts that it stands for."""
    n, span = int(sizes.sum()), depth - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < depth:
        return none.astype(np.uint64), none, none
    gram = sums.all(GRAM)
    bits = np.uint64(n.bit_length())
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # the first of equal hashes
    width = 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: n - depth + 1], least[span - width : span - width + n - depth + 1])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.repeat(np.cumsum(sizes), sizes)[: len(at)] - np.arange(len(at)) >= depth
    at[~inside] = -1
    change = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    real = at[first] >= 0
    return gram[at[first[real]]], first[real], last[real]


class Chunk:
    """Documents of a chunk: ids (None: after all others), sizes, and their bytes one after another."""

    def __init__(self, payload: bytes) -> None:
        self.ids, self.sizes, self.body = unpacked(payload)
        self.sizes = np.array(self.sizes, np.int64)
        self.order = np.array([LAST if x is None else x for x in self.ids], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first document, sizes, bytes) of runs of documents of about SLICE bytes."""
        data, groups = np.frombuffer(self.body, np.uint8), self.begins // SLICE
        edges = [*np.flatnonzero(np.diff(groups, prepend=-1)).tolist(), len(self.sizes)]
        for a, b in zip(edges, edges[1:]):
            sizes = self.sizes[a:b]
            yield a, sizes, data[self.begins[a] : self.begins[a] + int(sizes.sum())]


def chunks(docs: DataFrame, parts: int) -> DataFrame:
    """Messages of bucket -1, each a chunk of documents, dealt out by the chunk's number."""

    most = CHUNK * min(LARGEST, max(1, parts // PARTITIONS))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = text.as_py().encode()
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
                if size >= most:
                    yield from messages([(number, -1, packed((ids, [len(t) for t in texts], b"".join(texts))))]).to_batches()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from messages([(number, -1, packed((ids, [len(t) for t in texts], b"".join(texts))))]).to_batches()

    return docs.mapInArrow(close, MESSAGE_DDL).repartition(parts, "chunk")


def send_anchors(dealt: DataFrame, depth: int, buckets: int) -> DataFrame:
    """First pass: a chunk's distinct anchor hashes and how often it has each, by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch["chunk"].to_pylist(), batch["payload"], strict=True):
                found = [anchors(Sums(data), sizes, depth)[0] for _, sizes, data in Chunk(payload.as_py()).slices()]
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(number, b, packed((hashes[order[i:j]], n[order[i:j]].astype(np.uint32)))) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
                yield from messages(rows).to_batches()

    return dealt.mapInArrow(send, MESSAGE_DDL)


def repeated_anchors(sent: DataFrame, hot: int) -> DataFrame:
    """Replies: those of the chunk's hashes that occur twice or more, and which of them are hot."""

    def count(rows: pa.Table) -> pa.Table:
        came = [unpacked(x.as_py()) for x in rows["payload"]]
        hashes, back = np.unique(np.concatenate([h for h, _ in came]), return_inverse=True)
        total = np.bincount(back, np.concatenate([n for _, n in came]))
        out, at = [], 0
        for number, bucket, (h, _) in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), came, strict=True):
            n = total[back[at : at + len(h)]]
            at += len(h)
            if (n > 1).any():
                out.append((number, bucket, packed((h[n > 1], n[n > 1] > hot))))
        return messages(out)

    return sent.groupBy("bucket").applyInArrow(count, MESSAGE_DDL)


def send_windows(dealt: DataFrame, replies: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Second step: the surroundings of repeated anchors, by bucket: document, first window start, bytes.

    What occurs earlier in the same chunk is not sent; its windows are listed as removed, for the bucket to send back.
    """

    def send(whole: pa.Table, came: pa.Table) -> pa.Table:
        if not whole.num_rows or not came.num_rows:
            return messages([])
        chunk, number = Chunk(whole["payload"][0].as_py()), whole["chunk"][0].as_py()
        known = [unpacked(x.as_py()) for x in came["payload"]]
        hashes, hot = (np.concatenate(x) for x in zip(*known))
        order = np.argsort(hashes)
        hashes, hot = hashes[order], hot[order]
        found: list[list[np.ndarray]] = []
        for a, sizes, data in chunk.slices():
            sums = Sums(data)
            key, first, last = anchors(sums, sizes, depth)
            at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            some = hashes[at] == key
            key, first, last, is_hot = key[some], first[some], last[some], hot[at[some]]
            n = np.where(is_hot, last - first + 1, 1)  # hot anchors: each window by itself, by its own hash
            part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            is_hot, key, first, last = (np.repeat(x, n) for x in (is_hot, key, first, last))
            first, last = np.where(is_hot, first + part, first), np.where(is_hot, first + part, last)
            content = sums.of(first, last + depth) + (last - first).astype(np.uint64)
            begin = chunk.begins[a]
            found.append([np.where(is_hot, content, key), content, first + begin, last + 1 - first])
        if not sum(len(x[0]) for x in found):
            return messages([])
        key, content, first, n = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(chunk.begins + chunk.sizes, first, "right")
        start = first - chunk.begins[doc]
        order = np.lexsort((start, chunk.order[doc], content))
        fresh = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        later = (chunk.order[doc[order]] != chunk.order[doc[lead]]) | (start[order] != start[lead])
        for i in np.flatnonzero(later).tolist():  # the hash chose them, the bytes decide
            a, b, size = int(first[order[i]]), int(first[lead[i]]), int(n[order[i]]) + depth - 1
            later[i] = chunk.body[a : a + size] == chunk.body[b : b + size]
        gone, kept = order[later], order[~later]
        buckets_of = (key % np.uint64(buckets)).astype(np.int64)
        kept = kept[np.argsort(buckets_of[kept], kind="stable")]
        gone = gone[np.argsort(buckets_of[gone], kind="stable")]
        body, rows = np.frombuffer(chunk.body, np.uint8), []
        edges, edges_gone = (np.searchsorted(buckets_of[x], np.arange(buckets + 1)) for x in (kept, gone))
        for b in range(buckets):
            i, g = kept[edges[b] : edges[b + 1]], gone[edges_gone[b] : edges_gone[b + 1]]
            if len(i):
                data = b"".join([body[s : s + k].tobytes() for s, k in zip(first[i].tolist(), (n[i] + depth - 1).tolist())])
                rows.append((number, b, packed((doc[i].astype(np.int32), chunk.order[doc[i]], start[i], n[i].astype(np.int32), data, np.stack([doc[g], start[g], start[g] + n[g]])))))
        return messages(rows)

    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, MESSAGE_DDL)


def digits(data: np.ndarray, sizes: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """For each pass, the hash of the digit of all windows: n of each run of bytes, of the given sizes, in data."""
    ends, out = np.cumsum(sizes), []
    edges = [*np.flatnonzero(np.diff((ends - sizes) // SLICE, prepend=-1)).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        base = int(ends[a] - sizes[a])
        sums, k = Sums(data[base : ends[b - 1]]), n[a:b]
        begins = np.repeat(ends[a:b] - sizes[a:b] - base - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        out.append(np.stack([sums.of(begins + at, begins + min(depth, at + DIGIT)) for at in range(0, depth, DIGIT)]))
    return np.concatenate(out, axis=1)


def repeated_windows(found: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Which windows, given by their digits (a row for each pass), are equal to one of lower age.

    Passes from the most significant digit: windows are sorted within their groups; those that are alone leave. Equal
    windows agree in every 64-bit digit, of which a window of 100 bytes has two.
    """
    out, active, group = np.zeros(len(age), bool), np.arange(len(age)), np.zeros(len(age), np.int64)
    for k, digit in enumerate(found):
        value = digit[active]
        order = np.lexsort((value, group)) if k else np.argsort(value)
        active, group, value = active[order], group[order], value[order]
        same = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        group = np.cumsum(np.concatenate([[True], ~same]))[: len(group)]
        active, group = active[shared], group[shared]
    if len(active):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(age[active], heads), np.diff(heads, append=len(active)))
        out[active] = age[active] > least
    return out


def resolve(sent: DataFrame, depth: int) -> DataFrame:
    """Further passes in each bucket; replies: removed ranges of window starts, as document, start and end in rows."""

    def passes(rows: pa.Table) -> pa.Table:
        came = [unpacked(x.as_py()) for x in rows["payload"]]
        order, start, n = (np.concatenate([x[i] for x in came]) for i in (1, 2, 3))
        n = n.astype(np.int64)
        data = np.frombuffer(b"".join(x[4] for x in came), np.uint8)
        sizes = n + depth - 1
        part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rank = np.unique(order, return_inverse=True)[1].astype(np.uint64)
        age = np.repeat((rank << np.uint64(36)) + start.astype(np.uint64), n) + part.astype(np.uint64)
        gone = repeated_windows(digits(data, sizes, n, depth), age)
        out, at, w = [], 0, 0
        for number, bucket, x in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), came, strict=True):
            k = x[3].astype(np.int64)
            total = int(k.sum())
            mine, where = gone[w : w + total], part[w : w + total]
            change = (where == 0) | np.concatenate([[True], mine[1:] != mine[:-1]])
            begin = np.flatnonzero(change)
            run = np.diff(begin, append=total)
            owner = np.repeat(np.arange(len(k)), k)[begin]
            begin, run, owner = (v[mine[begin]] for v in (begin, run, owner))
            first = x[2][owner] + where[begin]
            ranges = np.concatenate([np.stack([x[0][owner].astype(np.int64), first, first + run]), x[5]], axis=1)
            at, w = at + len(k), w + total
            if ranges.shape[1]:
                out.append((number, bucket, packed(ranges)))
        return messages(out)

    return sent.groupBy("bucket").applyInArrow(passes, MESSAGE_DDL)


def cut(dealt: DataFrame, replies: DataFrame, depth: int) -> DataFrame:
    """Third step: each document with its removed spans and the bytes that stay."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(whole: pa.Table, came: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        chunk = Chunk(whole["payload"][0].as_py())
        edge = np.zeros(int(chunk.sizes.sum()) + 1, np.int32)
        for x in came["payload"]:
            doc, first, stop = unpacked(x.as_py())
            np.add.at(edge, chunk.begins[doc] + first, 1)
            np.add.at(edge, chunk.begins[doc] + stop - 1 + depth, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32, out=edge[:-1]) > 0
        body, spans, kept = np.frombuffer(chunk.body, np.uint8), [], []
        for b, n in zip(chunk.begins.tolist(), chunk.sizes.tolist()):
            mine = gone[b : b + n]
            turns = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
            spans.append([{"start": i, "end": j} for i, j in zip(turns[::2], turns[1::2])])
            kept.append(body[b : b + n][~mine].tobytes() if turns else chunk.body[b : b + n])
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(spans, kind), pa.array(kept, pa.binary())], names)

    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(apply, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, depth: int = 100, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans and kept of every row: what is removed of its UTF-8 bytes, and the bytes that stay.

    A byte is removed if it lies in a string of `depth` bytes that also starts earlier: in a document of smaller id, or
    in the same document further to the front. Strings are judged on the input and never reach across documents.

    Null texts count as empty; texts shorter than depth stay whole. Rows of null id come after all others and do not
    affect each other; nor do repeated rows of one id, which are the same document. Empty tables give empty results.
    """
    parts = shuffle_partitions(docs.sparkSession)
    dealt = chunks(id_and_text(docs, id_col, text_col), parts)
    replies = repeated_anchors(send_anchors(dealt, depth, parts), hot)
    return cut(dealt, resolve(send_windows(dealt, replies, depth, SPLIT * parts), depth), depth)
