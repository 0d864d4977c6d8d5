"""Byte-level BPE by a global shuffle of distinct words.

Each task splits its texts into words (matches of the tokenizer's pattern) and, per chunk of documents, keeps the
sequence of word numbers and the chunk's distinct words. The distinct words of all chunks meet by a hash of the word,
each is encoded once, and its ids go back to the chunks that asked for it; there the documents are put together by
position. Words and positions travel packed, so the shuffle carries a fraction of the text instead of a row per word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import besides, id_and_text, quoted, schema_of, shuffle_partitions, unused

#: Words of a chunk, at which it is closed; a document is never split, so a chunk may exceed this by one document. Each
#: chunk sends a message to each bucket, so with more partitions than PARTITIONS chunks grow with them, up to LARGEST times:
#: the number of messages for a gigabyte stays what it is until there are LARGEST times as many.
CHUNK_WORDS, PARTITIONS, LARGEST = 4_000_000, 256, 4
PACKED = "chunk long, bucket int, doc_ids array<long>, sizes array<int>, words binary, codes binary"


@lru_cache(2)
def load(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack(np.array([len(w) for w in words], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends, body = np.cumsum(unpack(data[4 : 4 + n]), dtype=np.int64).tolist(), zstandard.decompress(data[4 + n :])
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1 of all i, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def split_words(docs: DataFrame, pattern: str, buckets: int, most_words: int) -> DataFrame:
    """Rows of PACKED: for each chunk a row of bucket -1 with its documents, and a row for each bucket of its words."""

    def rows(chunk: int, ids: list, sizes: list[int], seen: dict[str, int], codes: list[np.ndarray]) -> Iterator[tuple]:
        by_bucket: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for word, code in seen.items():
            raw = word.encode()
            by_bucket[crc32(raw) % buckets].append((raw, code))
        order = []
        for bucket, words in enumerate(by_bucket):
            if words:
                words.sort()
                order += [code for _, code in words]
                yield chunk, bucket, None, None, pack_words([w for w, _ in words]), None
        yield chunk, -1, ids, sizes, pack(np.array(order, np.uint32)), pack(np.concatenate(codes) if codes else np.zeros(0, np.uint32))

    def batch(found: Iterator[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["chunk", "bucket", "doc_ids", "sizes", "words", "codes"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, chunk = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        ids, sizes, seen, codes, total = [], [], {}, [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                words = find(text.as_py())
                number = seen.setdefault
                codes.append(np.fromiter((number(w, len(seen)) for w in words), np.uint32, len(words)))
                ids.append(doc_id)
                sizes.append(len(words))
                total += len(words)
                if total >= most_words:
                    yield batch(rows(chunk, ids, sizes, seen, codes))
                    ids, sizes, seen, codes, total, chunk = [], [], {}, [], 0, chunk + 1
        if ids:
            yield batch(rows(chunk, ids, sizes, seen, codes))

    return docs.mapInArrow(split, PACKED)


def words_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of words, without the documents' rows."""
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch["bucket"], 0)).select(["chunk", "bucket", "words"])


def encode_words(words: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """chunk, bucket, counts and ids of its words in the order sent; each distinct word of a bucket is encoded once."""
    kinds = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())])

    def encode(rows: pa.Table) -> pa.Table:
        piece, known, out = load(vocabulary, pattern).encode_ordinary, {}, []  # a match of the pattern, by itself, is one match
        for chunk, bucket, packed in zip(*(rows[c].to_pylist() for c in ("chunk", "bucket", "words")), strict=True):
            asked = unpack_words(packed)
            for word in asked:
                if word not in known:
                    known[word] = np.array(piece(word.decode()), "<u4").tobytes()
            found = [known[w] for w in asked]
            out.append((chunk, bucket, pack(np.array([len(x) // 4 for x in found], np.uint32)), pack(np.frombuffer(b"".join(found), "<u4"))))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)], schema=kinds)

    return words.groupBy("bucket").applyInArrow(encode, "chunk long, bucket int, counts binary, ids binary")


def reassemble(streams: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id and ids: of each chunk, the documents' word numbers replaced by the words' ids."""
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def join(sent: pa.Table, came: pa.Table) -> pa.Table:
        came, sent = came.sort_by("bucket"), sent.filter(pc.equal(sent["bucket"], -1))
        none = [np.zeros(0, np.uint32)]
        counts = np.concatenate([unpack(x.as_py()) for x in came["counts"]] or none).astype(np.int64)
        pool = np.concatenate([unpack(x.as_py()) for x in came["ids"]] or none).astype(np.int32)
        order, codes = unpack(sent["words"][0].as_py()), unpack(sent["codes"][0].as_py())
        size_of, start_of = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        size_of[order], start_of[order] = counts, np.cumsum(counts) - counts
        doc_ids, ends = sent["doc_ids"].combine_chunks().flatten(), np.cumsum(sent["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, lengths, begin = [], np.zeros(len(ends), np.int64), 0
        for i in range(0, len(ends), 256):
            some = codes[begin : ends[min(i + 256, len(ends)) - 1]]
            sizes = size_of[some]
            parts.append(pool[ragged(start_of[some], sizes)])
            upto = np.concatenate([[0], np.cumsum(sizes)])[ends[i : i + 256] - begin]
            lengths[i : i + 256] = np.diff(upto, prepend=0)
            begin += len(some)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))
        return pa.table([doc_ids, ids], schema=kinds)

    return streams.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(join, "doc_id long, ids array<int>")


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text, by the ranks in the file `vocabulary` (present on every executor).

    No special tokens. Null and empty texts give an empty array. There is one row per input row, so repeated rows and
    null ids come back as often as they came; an empty table gives an empty result. The chunks are dealt out once and
    read twice (a filter in place of words_alone would move below the exchange, so that it could not be shared).
    """
    buckets = shuffle_partitions(docs.sparkSession)
    most_words = CHUNK_WORDS * min(LARGEST, max(1, buckets // PARTITIONS))
    packed = split_words(id_and_text(docs, id_col, text_col), pattern, buckets, most_words).repartition(buckets, "chunk")
    replies = encode_words(packed.mapInArrow(words_alone, "chunk long, bucket int, words binary"), vocabulary, pattern)
    return reassemble(packed, replies)


#: Bytes that the token-byte table may have to be sent to every executor.
TABLE_BYTES = 64_000_000


def token_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table (id, bytes) of the vocabulary: start and size of each id's bytes, and the bytes; -1 as size of an absent id."""
    with open(vocabulary, "rb") as lines:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    found = [tokens.get(i) for i in range(max(tokens) + 1)]
    sizes = np.array([-1 if x is None else len(x) for x in found], np.int64)
    filled = np.maximum(sizes, 0)
    table = np.cumsum(filled) - filled, sizes, np.frombuffer(b"".join(x or b"" for x in found), np.uint8)
    if (size := sum(x.nbytes for x in table)) > TABLE_BYTES:
        raise ValueError(f"a token table of {size} bytes is too large to be sent to all executors")
    return table


def bpe_decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns of encoded and `decoded`, the bytes of its ids; null ids give empty bytes.

    A broadcast join with the token-byte table of the vocabulary, whose size is checked: each id meets its row of the
    table inside the task, so ids need no shuffle. An id that the table lacks is an error. Rows are independent, so
    repeated rows and null ids of documents need no care; an empty table stays empty. A column named decoded, in either
    letter case, is replaced.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_table(vocabulary))
    kept, (column,) = besides(encoded, "decoded"), unused(encoded, "joined_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, body = table.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                asked = batch.column(batch.num_columns - 1).fill_null([])
                ids = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
                    raise ValueError("an id is not in the token table")
                counts = asked.value_lengths().to_numpy(zero_copy_only=False)
                spread = sizes[ids]
                upto = np.concatenate([[0], np.cumsum(spread)])[np.concatenate([[0], np.cumsum(counts)])]
                out = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto.astype("<i4").tobytes()), pa.py_buffer(body[ragged(starts[ids], spread)].tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*kept, "decoded"])

    rows = encoded.select(*quoted(kept), F.col(ids_col).alias(column))
    return rows.mapInArrow(decode, ", ".join(filter(None, [schema_of(encoded, kept), "decoded binary"])))
