"""Near-duplicate vectors by spherical-cap filters: random product codes, list decoding, a join on filters, exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import shuffle_partitions, stored
from tallybook.llm.components import connected_components

#: Filter directions of each code that a vector is listed under; codes for each block of a direction.
LISTED, CODES = 4, 3
#: Directions of a code for each vector of the largest label; code words of one block at most.
SPARSE, BLOCK_WORDS = 64, 1024
#: Vectors of one block of a filter's members; two blocks are compared at a time.
BLOCK = 512
#: Vectors whose inner products with the code words are held at a time.
TOGETHER = 2048
SEED = 13


def plan_of_codes(largest: int) -> tuple[int, int, int]:
    """Codes, blocks of a direction, and code words of each block, for a label of so many vectors.

    A code has about SPARSE directions for each vector, so that the strangers a vector meets under a direction do not
    grow with the table. More blocks keep the code words few, 10^9 vectors take 4 blocks of 503, and more codes make up
    for what blocks lose.
    """
    directions = SPARSE * max(largest, 64)
    blocks = max(2, math.ceil(math.log(directions) / math.log(BLOCK_WORDS)))
    return CODES * blocks, blocks, math.ceil(directions ** (1 / blocks))


def product_codes(dims: int, number: int, blocks: int, words: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each code a random rotation and the unit code words of each block. A direction is one word of every block;
    rotations spread a vector's length over the blocks."""
    draw = np.random.default_rng([SEED, dims, blocks, words])
    codes = []
    for _ in range(number):
        rotation = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
        parts = [p for p in np.array_split(np.arange(dims), blocks) if len(p)]
        found = [draw.normal(size=(words, len(p))) for p in parts]
        codes.append((rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in found]))
    return codes


def decoded(units: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    """Numbers of the LISTED directions nearest to each unit vector: those whose caps of the vector's own height hold it.

    Inner products of a direction are sums over the blocks, so the best directions of the first blocks, LISTED of them,
    begin all the best ones of one block more.
    """
    rotation, blocks = code
    turned, numbers, sums, at = units @ rotation, np.zeros((len(units), 1), np.int64), np.zeros((len(units), 1)), 0
    for words in blocks:
        products = turned[:, at : at + words.shape[1]] @ words.T
        at += words.shape[1]
        few = min(LISTED, len(words))
        best = np.argpartition(-products, few - 1, axis=1)[:, :few]
        both = (sums[:, :, None] + np.take_along_axis(products, best, 1)[:, None, :]).reshape(len(units), -1)
        named = (numbers[:, :, None] * len(words) + best[:, None, :]).reshape(len(units), -1)
        few = min(LISTED, both.shape[1])
        kept = np.argpartition(-both, few - 1, axis=1)[:, :few]
        numbers, sums = np.take_along_axis(named, kept, 1), np.take_along_axis(both, kept, 1)
    return numbers


def scaled(vector: bytes) -> np.ndarray:
    """A stored vector divided by its largest entry, so that no square over- or underflows."""
    x = np.frombuffer(vector, "<f8")
    return x / np.abs(x).max()


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's digest of label and vector, and its vector as bytes; null for what links with nothing."""
    for batch in batches:
        digests, vectors = [], []
        for label, entries in zip(batch["label"].to_pylist(), batch["entries"], strict=True):
            x = None
            if label is not None and entries.is_valid and len(entries) and not entries.values.null_count:
                x = np.asarray(entries.values, "<f8") + 0.0  # no negative zeros
                x = x if np.isfinite(x).all() and x.any() else None
            vectors.append(None if x is None else x.tobytes())
            digests.append(None if x is None else hashlib.blake2b(vectors[-1], digest_size=16, salt=hashlib.blake2b(label.encode(), digest_size=16).digest()).digest())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "digest", "vector"])


def listed_under(classes: DataFrame, number: int, blocks: int, words: int) -> DataFrame:
    """digest, label and keys of each class: the numbers of its directions, marked by code and number of dimensions."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                vectors = [scaled(v) for v in batch["vector"].to_pylist()]
                out: list = [None] * len(vectors)
                for dims in {len(v) for v in vectors}:
                    if dims not in codes:
                        codes[dims] = product_codes(dims, number, blocks, words)
                    rows = [i for i, v in enumerate(vectors) if len(v) == dims]
                    units = np.stack([vectors[i] for i in rows])
                    units /= np.linalg.norm(units, axis=1, keepdims=True)
                    found = []
                    for place, code in enumerate(codes[dims]):
                        mark = (dims * number + place) * 0x1D8E4E27C47D124F % 2**63
                        found.append(decoded(units, code) ^ np.int64(mark))
                    for i, k in zip(rows, np.concatenate(found, axis=1), strict=True):
                        out[i] = k
                yield pa.RecordBatch.from_arrays([batch["digest"], batch["label"], pa.array(out, pa.list_(pa.int64()))], ["digest", "label", "keys"])

    return classes.select("digest", "label", "vector").mapInArrow(keys, "digest binary, label string, keys array<long>")


def _met_before(keys: list[np.ndarray], key: int) -> np.ndarray:
    """Whether two members share a key below this one, where they have met already: counts of shared keys, in strips."""
    before = [k[k < key] for k in keys]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in before])
    values, column, times = np.unique(np.concatenate([*before, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    several = times > 1
    rank = np.cumsum(several) - 1
    met = np.zeros((len(keys), len(keys)), bool)
    for first in range(0, int(several.sum()), TOGETHER):
        some = several[column] & (rank[column] >= first) & (rank[column] < first + TOGETHER)
        marks = np.zeros((len(keys), min(TOGETHER, int(several.sum()) - first)), np.float32)
        marks[owner[some], rank[column[some]] - first] = 1
        met |= marks @ marks.T > 0
    return met


def compared(rows: list[dict], one: int, other: int, least_cosine: float) -> list[tuple[bytes, int, int, int]]:
    """digest, links, u, v of members with links in a pair of blocks: the rows that other classes stand for, counted
    where the two meet first, and the least id of the component here."""
    keys = [np.asarray(r["keys"], np.int64) for r in rows]
    vectors = [scaled(r["vector"]) for r in rows]
    sizes, block = np.array([len(v) for v in vectors]), np.array([r["block"] for r in rows])
    linked = np.zeros((len(rows), len(rows)), bool)
    for dims in set(sizes.tolist()):
        at = np.flatnonzero(sizes == dims)
        some = np.stack([vectors[i] for i in at])
        length = np.linalg.norm(some, axis=1)
        linked[np.ix_(at, at)] = (some @ some.T) / (length[:, None] * length[None, :]) >= least_cosine
    np.fill_diagonal(linked, False)
    linked |= linked.T
    if one != other:
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(1))
    if not len(some):
        return []
    linked = linked[np.ix_(some, some)]
    fresh = linked & ~_met_before([keys[i] for i in some], rows[0]["key"])
    weights, ids = np.array([rows[i]["weight"] for i in some], np.int64), np.array([rows[i]["class_id"] for i in some], np.int64)
    links, least = np.where(fresh, weights, 0).sum(1), ids.copy()
    while True:
        lower = np.minimum(least, np.where(linked, least, np.iinfo(np.int64).max).min(1))
        if (lower == least).all():
            break
        least = lower
    return [(rows[i]["digest"], int(n), int(u), int(v)) for i, n, u, v in zip(some.tolist(), links, ids, least, strict=True)]


def _verified(members: DataFrame, cosine: float) -> DataFrame:
    """digest, links, u, v over all pairs of blocks of the filters' members."""
    keys = ["label", "key", "one", "other"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and any(row[k] != rows[0][k] for k in keys):
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            found = compared(rows, rows[0]["one"], rows[0]["other"], cosine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), *[pa.int64()] * 3), strict=True)], ["digest", "links", "u", "v"])

    dealt = members.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(verify, "digest binary, links long, u long, v long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows of one label are linked if their cosine, in double precision, is at least `cosine`. Equal vectors of a label
    are one class. Each class is listed under the LISTED nearest directions of each of several product codes: the caps
    around a vector's directions are as high as its own LISTED best ones, as caps of one height for all would miss pairs
    whose halves are uneven. Classes that share a direction meet, in blocks of BLOCK, and only what the exact cosine
    confirms counts, at the first direction that the two share. A pair that shares no direction is missed: at a cosine
    of 0.98 with a probability of some 1e-8 for thousands of vectors, 1e-6 for 10^9, as the codes' own rates give it.

    Vectors that are null, empty, zero, or hold null or non-finite entries link with nothing, like those of null label,
    of null id, and of different lengths among each other. Rows of null id have null component_id and are not kept.
    Repeated rows are linked with each other, and rows that share an id are one node of components. Columns of other
    names stay behind. An empty table gives an empty result.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("entries"))
    rows = rows.mapInArrow(_usable, "vec_id long, label string, digest binary, vector binary")
    classes = stored(rows.where("digest is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    listed = stored(listed_under(classes, *plan_of_codes(largest)))
    under = listed.select("digest", "label", F.explode("keys").alias("key"))
    shared = under.groupBy("label", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = under.join(shared, ["label", "key"]).groupBy("digest").agg(F.collect_list(F.struct("key", "members")).alias("places"))
    members = lists.join(classes, "digest").withColumns({"keys": F.col("places.key"), "place": F.explode("places")}).withColumn("blocks", F.ceil(F.col("place.members") / BLOCK))
    members = members.withColumn("block", F.pmod(F.xxhash64("digest", "place.key"), F.col("blocks"))).withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("label", F.col("place.key").alias("key"), F.least("block", "meets").alias("one"), F.greatest("block", "meets").alias("other"), "block", "digest", "class_id", "weight", "vector", "keys")
    found = stored(_verified(members, cosine))
    components = connected_components(found.select("u", "v")).withColumnRenamed("id", "node")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "class_id", "weight").join(links, "digest", "left").join(components, F.col("class_id") == F.col("node"), "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    ids = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return ids.join(known, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
