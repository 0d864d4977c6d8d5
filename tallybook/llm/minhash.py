"""Near-duplicate detection by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_and_text, shuffle_partitions, stored, unused
from tallybook.llm.components import connected_components
from tallybook.llm.shingles import mixed, set_digest, shingle_sets

#: Minima of each text, and the most rows of them in a band.
MINIMA, MOST_ROWS = 364, 7
#: Probability, at most, that a pair at the threshold shares no band.
MISSED = 1e-5
#: Low bits that are kept of each minimum.
BITS = 2
#: Pairs go to the full sets unless their estimate is more than so many of its standard deviations below the threshold.
DEVIATIONS = 6.5
#: Texts and shingles in one block of a cluster, in which all pairs are estimated, and texts whose pairs are at once.
BLOCK_TEXTS, BLOCK_SHINGLES, STRIP = 4096, 3_000_000, 256
#: Blocks of a cluster up to which all pairs of blocks cost less than dealing it out again to join large families first.
FEW = 8
BATCH = 64


def banding(percent: int) -> tuple[int, int]:
    """Rows in a band and bands: as many rows as leave a pair of the threshold's similarity unmet with probability MISSED.

    7 and 52 from 80 % on, where pairs are missed with probability 5e-6 (2e-9 at 85 %); below 4 % there is no such banding.
    """
    for rows in range(MOST_ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (MINIMA // rows) <= MISSED:
            return rows, MINIMA // rows
    raise ValueError(f"a similarity of {percent} % cannot be searched with {MINIMA} minima")


def least_estimate(percent: int) -> float:
    """The estimate below which a pair is not confirmed: 0.71 for 85 %."""
    chance, similarity = 0.5**BITS, percent / 100
    alike = chance + (1 - chance) * similarity
    return similarity - DEVIATIONS * (alike * (1 - alike) / MINIMA) ** 0.5 / (1 - chance)


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240301)
    return draw.integers(1, 1 << 63, MINIMA, np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, MINIMA, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Texts by MINIMA: the least value of each permutation over each non-empty set."""
    factor, shift = permutations()
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), MINIMA), np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(flat * factor[k] + shift[k], starts)
    return mixed(out)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum, packed in 64-bit words: bit planes, one after another."""
    planes = [np.packbits((least >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    width = -(-planes[0].shape[1] // 8) * 8
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in planes], axis=1).view("<u8")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the rows of packed bits a (down) and b (across), corrected for minima that agree by chance."""
    plane = a.shape[1] // BITS
    differ = np.zeros((len(a), len(b)), np.uint16)
    for w in range(plane):
        unlike = np.zeros((len(a), len(b)), np.uint64)
        for k in range(w, a.shape[1], plane):
            unlike |= a[:, k, None] ^ b[None, :, k]
        differ += np.bitwise_count(unlike)
    chance = 0.5**BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int, band_rows: int, bands_each: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, bits (packed) and bands (a hash for each); nulls for empty sets."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["doc_id", "n_shingles", "digest", "bits", "bands"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                sets = shingle_sets([t.encode() for t in batch["text"].to_pylist()], width)
                some = [k for k, s in enumerate(sets) if len(s)]
                digests, bits, bands = ([None] * len(sets) for _ in range(3))
                if some:
                    least = minima([sets[k] for k in some])
                    packed = packed_bits(least)
                    keys = np.broadcast_to(np.arange(bands_each, dtype=np.uint64), (len(some), bands_each)).copy()
                    for r in range(band_rows):
                        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r : band_rows * bands_each : band_rows])
                    for at, k in enumerate(some):
                        digests[k], bits[k], bands[k] = set_digest(sets[k]), packed[at].tobytes(), keys[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((batch["doc_id"].to_pylist(), [len(s) for s in sets], digests, bits, bands), kinds, strict=True)], names)

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, bits binary, bands array<long>")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """id and component: classes that are joined by chains of shared bands.

    Each band's bucket becomes a star around its least class, so a bucket gives as many links as it has members.
    """
    rows = classes.select("class_id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most").select("band", "least")
    return connected_components(rows.join(buckets, "band").where("class_id <> least").select(F.col("class_id").alias("u"), F.col("least").alias("v")).distinct())


class Forest:
    """Union by least index, with path halving."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def confirmed(known: list[int], blocks: list[int], bits: np.ndarray, sets: list[np.ndarray], one: int, other: int, percent: int) -> list[tuple[int, int]]:
    """Known components that the similar pairs of two blocks (or of one with itself) connect, each with the least of its own.

    Pairs of a strip are tried from the highest estimate down; the sets are intersected unless the pair is connected already.
    """
    down, across = (np.array([i for i, b in enumerate(blocks) if b == x], np.int64) for x in (one, other))
    least, group = np.unique(known, return_inverse=True)
    forest = Forest(len(least))
    for begin in range(0, len(down), STRIP):  # what one strip connects, the next ones need not try
        strip = down[begin : begin + STRIP]
        root = np.array([forest.root(k) for k in range(len(least))])[group]
        guess = estimates(bits[strip], bits[across])
        tried = (guess >= least_estimate(percent)) & (root[strip][:, None] != root[across][None, :])
        if one == other:
            tried &= strip[:, None] < across[None, :]
        at = np.argwhere(tried)
        for i, j in at[np.argsort(-guess[at[:, 0], at[:, 1]], kind="stable")].tolist():
            a, b = strip[i], across[j]
            x, y = sets[a], sets[b]
            if forest.root(group[a]) == forest.root(group[b]) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                forest.link(group[a], group[b])
    return [(int(least[k]), int(least[root])) for k in range(len(least)) if (root := forest.root(k)) != k]


def confirm(members: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """u and v: known components that similar pairs of the dealt blocks connect; v is the least that is met in a place.

    members: class_id, known (its component so far), digest, bits, cluster, block, and places (the pairs of blocks that
    the block takes part in); source: doc_id and text. Texts travel once, the full sets once for each place.
    """
    placed = members.withColumn("place", F.explode("places")).select("class_id", "known", "digest", "bits", F.struct("cluster", "block", "place.one", "place.other").alias("place"))
    members = placed.groupBy("class_id", "known", "digest", "bits").agg(F.collect_list("place").alias("places"))
    members = members.join(source, F.col("class_id") == F.col("doc_id")).drop("doc_id")
    carried = ["places", "class_id", "known", "bits"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                sets = shingle_sets([t.encode() for t in batch["text"].to_pylist()], width)
                same = [set_digest(s) == d for s, d in zip(sets, batch["digest"].to_pylist(), strict=True)]  # else a repeated id
                out = pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array([s.tobytes() for s in sets], pa.binary())], [*carried, "shingles"])
                yield out.filter(pa.array(same))

    sets = members.mapInArrow(expand, "places array<struct<cluster:bigint,block:bigint,one:bigint,other:bigint>>, class_id long, known long, bits binary, shingles binary")
    dealt = sets.withColumn("place", F.explode("places")).selectExpr("place.cluster", "place.one", "place.other", "place.block", "class_id", "known", "bits", "shingles")
    dealt = dealt.repartition(shuffle_partitions(members.sparkSession), "cluster", "one", "other").sortWithinPartitions("cluster", "one", "other", "block", "class_id")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["cluster"], row["one"], row["other"]) != key:
                    if rows:
                        yield key, rows
                    key, rows = (row["cluster"], row["one"], row["other"]), []
                if not rows or row["class_id"] != rows[-1]["class_id"]:  # a repeated id comes once
                    rows.append(row)
        if rows:
            yield key, rows

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, other), rows in groups(batches):
            bits = np.frombuffer(b"".join(r["bits"] for r in rows), "<u8").reshape(len(rows), -1)
            links = confirmed([r["known"] for r in rows], [r["block"] for r in rows], bits, [np.frombuffer(r["shingles"], np.uint64) for r in rows], one, other, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["u", "v"])

    return dealt.mapInArrow(verify, "u long, v long")


def weight(count: Column, shingles: Column) -> Column:
    """How many blocks so many texts and shingles fill."""
    return F.greatest(count / BLOCK_TEXTS, shingles / BLOCK_SHINGLES)


def dealt_once(members: DataFrame, deal: int) -> DataFrame:
    """Members of each cluster dealt out over its blocks by a hash, each block for itself."""
    block = F.pmod(F.xxhash64("class_id", F.lit(deal)), F.col("blocks")).cast("long")
    return members.withColumn("block", block).withColumn("places", F.array(F.struct(F.col("block").alias("one"), F.col("block").alias("other"))))


def filled(rows: DataFrame, group: str) -> DataFrame:
    """Of each group and component in it: how many blocks it fills."""
    return rows.groupBy(group, "known").agg(weight(F.count(F.lit(1)), F.sum("n_shingles")).alias("fill"))


def dealt_across(rows: DataFrame) -> DataFrame:
    """Members of each cluster that holds several components, dealt out as pairs of blocks of different ones.

    A component that fills more than a block has blocks of its own, which need not meet each other; smaller ones share
    blocks. So a large family and a few strays give as many pairs as the family has blocks.
    """
    parts = filled(rows, "cluster")
    several = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.ceil(F.sum(F.when(F.col("fill") <= 1, F.col("fill")))).alias("pools")).where("parts > 1").drop("parts")
    parts = parts.join(several, "cluster").withColumn("own", F.when(F.col("fill") > 1, F.ceil("fill").cast("long")))

    def labelled(number: Column) -> Column:
        """A block's label: of a component's own block, or of a shared one."""
        return F.when(F.col("own").isNotNull(), F.xxhash64("known", number)).otherwise(F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("known"), F.greatest("pools", F.lit(1)))))

    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("own") - 1, F.lit(0))))
    blocks = parts.withColumn("number", numbers).select("cluster", labelled(F.col("number")).alias("block"), F.when(F.col("own").isNotNull(), F.col("known")).alias("of")).distinct()
    others = blocks.select("cluster", F.col("block").alias("second"), F.col("of").alias("of_second"))
    meet = blocks.join(others, "cluster").where("(of IS NULL AND of_second IS NULL AND block <= second) OR (of IS NULL AND of_second IS NOT NULL) OR (of < of_second)")
    pair = F.struct(F.col("block").alias("one"), F.col("second").alias("other"))
    both = meet.select("cluster", "block", pair.alias("place")).unionByName(meet.where("block <> second").select("cluster", F.col("second").alias("block"), pair.alias("place")))
    places = both.groupBy("cluster", "block").agg(F.collect_list("place").alias("places"))
    number = F.pmod(F.xxhash64("class_id"), F.col("own"))
    rows = rows.join(parts.select("cluster", "known", "own", "pools"), ["cluster", "known"]).withColumn("block", labelled(number))
    return rows.select("cluster", "class_id", "known", "digest", "bits", "block").join(places, ["cluster", "block"])


def dealt_rest(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large clusters that hold several components: dealt out across the cluster, or across each bucket of a
    band that holds several, whichever sends fewer full sets. Either way every pair that shares a band meets."""
    whole = filled(members, "cluster").groupBy("cluster").agg(F.ceil(F.sum(F.when(F.col("fill") <= 1, F.col("fill")))).alias("pools"), F.sum(F.when(F.col("fill") > 1, F.ceil("fill"))).alias("own"), F.sum(F.when(F.col("fill") > 1, F.ceil("fill") * F.ceil("fill"))).alias("apart"))
    every = F.coalesce("pools", F.lit(0)) + F.coalesce("own", F.lit(0))
    whole = whole.select("cluster", ((every * every - F.coalesce("apart", F.lit(0))) * BLOCK_TEXTS).alias("across"))
    rows = members.join(classes.select("class_id", "bands"), "class_id").withColumn("band", F.explode("bands")).drop("bands")
    mixed_bands = rows.groupBy("band").agg(F.min("known").alias("least"), F.max("known").alias("most")).where("least < most").select("band")
    rows = rows.join(mixed_bands, "band")
    routes = whole.join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("sent")), "cluster").select("cluster", (F.col("across") <= F.col("sent")).alias("at_once"))
    at_once = members.join(routes.where("at_once"), "cluster", "left_semi")
    by_band = rows.join(routes.where("NOT at_once"), "cluster", "left_semi").drop("cluster").withColumnRenamed("band", "cluster")
    return dealt_across(stored(at_once.unionByName(by_band.select(*at_once.columns))))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two texts are linked if the intersection of their shingle sets is at least `percent` hundredths of the union;
    component_id is the smallest id that links reach, kept marks the row that has it. Texts of equal sets are one class
    from the start. Classes that share a band, directly or by a chain, form clusters. A cluster of one block has all its
    pairs estimated from b-bit signatures, and those near or above the threshold confirmed on the full sets, unless what
    is confirmed connects them already. A larger cluster is dealt out over random blocks, and one of more than FEW
    blocks once more, which joins large families at the cost of their size; after that only clusters, or buckets of them, that still hold several components
    are searched, and only between these. The bands follow from percent; below 4 % no banding finds the pairs, and ValueError is raised.

    Null texts count as empty; a text without words has an empty set and is linked with nothing. Rows of null id have
    null component_id, are not kept and link nothing, but equal sets of other rows are unaffected. Repeated rows are
    linked and share one id, so each is kept. An empty table gives an empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    rows = stored(sketches(source, width, *banding(percent)))
    classes = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    clusters = stored(candidate_clusters(classes))
    members = clusters.withColumnRenamed("component", "cluster").join(classes.select("class_id", "digest", "bits", "n_shingles"), F.col("id") == F.col("class_id")).drop("id")
    sizes = members.groupBy("cluster").agg(F.ceil(weight(F.count(F.lit(1)), F.sum("n_shingles"))).alias("blocks"))
    members = stored(members.join(sizes, "cluster").withColumn("known", F.col("class_id")))
    links = stored(confirm(dealt_once(members, 0), source, width, percent))
    # blocks of one deal share no text, so the links are stars around components already
    labels = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if not members.where("blocks > 1").isEmpty():

        def so_far(least: int) -> DataFrame:
            return stored(members.where(F.col("blocks") > least).drop("known").join(labels, F.col("class_id") == F.col("id"), "left").withColumn("known", F.coalesce("component", "class_id")).drop("id", "component"))

        if not members.where(F.col("blocks") > FEW).isEmpty():
            links = stored(links.unionByName(confirm(dealt_once(so_far(FEW), 1), source, width, percent)))
            labels = connected_components(links)
        links = stored(links.unionByName(confirm(dealt_rest(so_far(1), classes), source, width, percent)))
        labels = connected_components(links)
    named = classes.select("digest", "class_id").join(labels, F.col("class_id") == F.col("id"), "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near_duplicates, with all its columns; rows without words or id stay."""
    (gone_id,) = unused(docs, "gone_id")
    gone = near_duplicates(docs, percent, width, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
