"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are a bounded sample of the rows with label 1; no row with label 0 enters the fit, the prior or the
calibration. The unlabelled texts are all texts: one pass counts their hashed words and byte n-grams, one sums the
products of their features, from which the risk of any linear model with squared loss follows exactly, and another counts
the margins of the candidate models, one for each prior of a grid. Features tell how usual a text's words and n-grams are
among all texts (Content), and what shares of its characters, words and lines have which form. The
prior is estimated from the margins of a model that tells positives from unlabelled texts, and the scores are calibrated
by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import besides, quoted, schema_of, shuffle_partitions, unused
from tallybook.llm.filter_audit import CLASSES as CHARACTERS
from tallybook.llm.filter_audit import SPACE
from tallybook.llm.filter_audit import _hashed as word_hashes

#: Texts of label 1, about, that a model is fitted on, chosen by a hash of the id, whole texts; share that gives the
#: weights, while the rest gives the prior, the calibration and the support.
POSITIVES, FITTED = 5000, 0.7
#: Buckets of hashed words and of hashed byte n-grams, and the n-grams' length.
WORDS, GRAMS, GRAM = 1 << 15, 1 << 16, 4
#: Character classes: small letter, capital, digit, space, line end, other space, other, then each ASCII mark.
CLASSES, COARSE = 40, 8
#: Measures of words and lines, of content, and the constant 1 behind all features.
MEASURES, CONTENT = 7, 4
FEATURES = CLASSES + COARSE * COARSE + MEASURES + CONTENT + 1
#: Where the measures of how usual words and n-grams are stand among the features.
USUAL_AT = [FEATURES - 1 - CONTENT, FEATURES - 1 - CONTENT + 2]
#: Characters of the corpus' own mean that are counted with each text, so that very short texts are no outliers.
USUAL = 200
#: What is counted over all texts: words, n-grams, character classes, pairs of them, and characters.
COUNTS = WORDS + GRAMS + CLASSES + COARSE * COARSE + 1
BLOCK = 1024
#: Priors for which candidate models are made.
PRIORS = np.arange(1, 20) / 20
#: Bins of a margin's histogram, from -REACH to REACH, and the width in bins of the kernel that smooths them.
BINS, REACH, KERNEL = 400, 4.0, 8.0
#: Share of the positives that must lie above a margin for it to bound the prior.
ABOVE = 0.5
BATCH = 64


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of each code point, below CLASSES."""
    found = np.full(0x110000, 6, np.uint8)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            found[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            found[i] = 2
        elif c.isspace():
            found[i] = {" ": 3, "\n": 4}.get(c, 5)
    marks = [i for i in range(33, 127) if not chr(i).isalnum()]
    found[marks] = 7 + np.arange(len(marks))
    return found


def classes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each text has each class and each pair of coarse classes, and its size with the line end put behind it."""
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = character_classes()[raw].astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    single = np.bincount(row * CLASSES + kind, minlength=len(texts) * CLASSES).reshape(len(texts), -1)
    coarse = np.minimum(kind, COARSE - 1)
    inside = np.ones(len(raw), bool)
    inside[np.cumsum(sizes) - 1] = False  # no pair begins with the line end put behind each text
    pair = (row[:-1] * COARSE + coarse[:-1]) * COARSE + coarse[1:]
    pairs = np.bincount(pair[inside[:-1]], minlength=len(texts) * COARSE * COARSE).reshape(len(texts), -1)
    return single, pairs, sizes


def hashed(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all words and of all byte n-grams of whole texts."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b" ".join([*coded, bytes(8)]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    stop = int(ends[-1]) + 1 if len(coded) else 0
    blank = CHARACTERS[data[:stop]] == SPACE
    before = np.concatenate([[True], blank[:-1]])
    starts, stops = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    words = (word_hashes(data, starts, stops - starts, np.zeros(len(starts), np.uint64)) >> np.uint64(40)).astype(np.int64) % WORDS
    grams = np.ndarray(max(stop - GRAM + 1, 0), "<u4", data, strides=(1,)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    row = np.repeat(np.arange(len(coded)), sizes + 1)[: len(grams)]
    whole = np.arange(len(grams)) + GRAM <= ends[row] if len(grams) else np.zeros(0, bool)
    return (np.searchsorted(ends, starts), words), (row[whole], grams[whole].astype(np.int64) % GRAMS)


@dataclass
class Content:
    """What counts of the corpus tell of a text: for each bucket of words and of n-grams the logarithm of its share, less
    the mean over all texts; and the shares of character classes and of pairs, and words for each character."""

    usual: tuple[np.ndarray, np.ndarray]
    classes: np.ndarray
    pairs: np.ndarray
    words: float

    @staticmethod
    def of(corpus: np.ndarray) -> Content:
        usual, at = [], 0
        for buckets in (WORDS, GRAMS):
            n = corpus[at : at + buckets].astype(float)
            at += buckets
            share = (n + 1) / (n.sum() + buckets)
            usual.append((np.log(share) - share @ np.log(share)).astype(np.float32))
        characters = max(float(corpus[-1]), 1.0)
        return Content(tuple(usual), corpus[at : at + CLASSES] / characters, corpus[at + CLASSES : -1] / characters, float(corpus[:WORDS].sum()) / characters)

    def measures(self, texts: list[str]) -> np.ndarray:
        """Texts by CONTENT: of words and of n-grams how usual they are in the mean, drawn to 0 by USUAL characters, and its square."""
        out = np.zeros((len(texts), CONTENT))
        for i, (row, bucket) in enumerate(hashed(texts)):
            n = np.bincount(row, minlength=len(texts)) + USUAL * (self.words if i == 0 else 1.0)
            out[:, 2 * i] = np.bincount(row, self.usual[i][bucket], len(texts)) / np.maximum(n, 1e-9)
            out[:, 2 * i + 1] = out[:, 2 * i] ** 2
        return out


def features(texts: list[str], content: Content | None = None) -> np.ndarray:
    """Texts by FEATURES: roots of the shares of character classes and of pairs of them, measures of repetition and form,
    and measures of content, which are 0 without one."""
    single, pairs, sizes = classes_of(texts)
    plain, plain_pairs, n_words = (USUAL * x for x in (content.classes, content.pairs, content.words)) if content else (np.zeros(CLASSES), np.zeros(COARSE * COARSE), 0.0)
    letters = plain[0] + plain[1]
    out = np.ones((len(texts), FEATURES))
    out[:, :CLASSES] = np.sqrt((single + plain) / (sizes + plain.sum())[:, None])
    out[:, CLASSES : CLASSES + COARSE * COARSE] = np.sqrt((pairs + plain_pairs) / np.maximum(sizes - 1 + plain_pairs.sum(), 1)[:, None])
    out[:, -CONTENT - 1 : -1] = content.measures(texts) if content else 0.0
    for i, text in enumerate(texts):
        words, lines = text.split(), text.split("\n")
        n = max(1, len(words))
        more = n + n_words
        out[i, -MEASURES - CONTENT - 1 : -CONTENT - 1] = (
            (len(set(words)) + n_words) / more,
            len({w.lower() for w in words}) / n / max(0.05, min(1.0, 12 / n**0.5)),
            len(set(lines)) / len(lines),
            min((sum(map(len, words)) + letters) / more, 40) / 10,
            np.log1p(more) / 10,
            min(more / (len(lines) + 2), 100) / 100,
            min(max(map(len, words), default=0), 400) ** 0.5 / 20,
        )
    return out


@dataclass
class Model:
    """Weights of the features; slope and shift turn the margin into a calibrated log-odds; the prior that was estimated;
    the content that features are measured by."""

    weights: np.ndarray
    slope: float
    shift: float
    prior: float
    content: Content | None = None
    support: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability, which fades away where a text's words or n-grams are less usual than positives' ever are."""
        margin = (x * self.weights).sum(1)  # row by row, so that equal texts have equal scores in any batch
        score = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))
        if self.support is None:
            return score
        low, width = self.support
        return score * np.exp(-np.clip((low - x[:, USUAL_AT]) / width, 0, 30).max(1))


def support_of(x: np.ndarray) -> np.ndarray:
    """Of positives' features: for the usualness of words and of n-grams where support ends, and in which width it fades.

    The width is the distance from the median to the hundredth least; support ends as far again below that one. Linear
    risk sees only what the unlabelled texts hold: of text unlike all of them it knows nothing, and no trusted positive
    speaks for it.
    """
    usual = x[:, USUAL_AT]
    middle, least = np.median(usual, 0), np.quantile(usual, 0.01, 0)
    width = np.maximum(middle - least, 0.05)
    return np.stack([middle - 2 * width, width])


def negative_risk(w: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """E_u[l(-)] - prior * E_p[l(-)] of squared loss l = (1 + margin)^2 / 4, from mean products of features, constant last."""
    of_u, of_p = (1 + 2 * s[-1] @ w + w @ s @ w for s in (unlabelled, positive))
    return float(of_u - prior * of_p) / 4


def minimise_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]), squared loss l.

    The risk is the greater of two convex parabolas of the weights, with and without the second part. Its minimum is
    the minimum of a mean of the two, whose share is found by halving: all of the second part if that is not negative
    then, else as much of it as makes it zero.
    """

    free = np.diag([*np.ones(len(positive) - 1), 0.0])  # the constant's weight is not held back

    def least(share: float) -> np.ndarray:
        matrix = (prior * (1 - share) * positive + share * unlabelled) / 2 + ridge * free
        return np.linalg.solve(matrix, (prior * (1 + share) * positive[-1] - share * unlabelled[-1]) / 2)

    whole = least(1.0)
    if negative_risk(whole, unlabelled, positive, prior) >= 0:
        return whole
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        if negative_risk(least(middle), unlabelled, positive, prior) >= 0:
            low = middle
        else:
            high = middle
    return least(low)


def binned(margins: np.ndarray) -> np.ndarray:
    return np.clip((margins + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from counts of margins by bin.

    Above any margin lie at least prior times the share of positives that lies there, so the least ratio of the two
    shares, over margins with enough positives above them, bounds the prior, and meets it where no negatives are.
    """
    of_p, of_u = (x[::-1].cumsum() / x.sum() for x in (positive, unlabelled))
    return float(np.clip((of_u / np.maximum(of_p, 1e-12))[of_p >= ABOVE].min(), 0.02, 0.98))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the log-odds, from counts of margins by bin: logistic regression on each bin's share of positives.

    That share is prior times the density of positives over that of all texts, both smoothed. Newton's method, with a
    weak pull to 1 and 0.
    """
    at = np.arange(BINS)
    kernel = np.exp(-0.5 * ((at[:, None] - at[None, :]) / KERNEL) ** 2)
    p, u = (kernel @ (x / x.sum()) for x in (positive, unlabelled))
    share = np.clip(prior * p / np.maximum(u, 1e-12), 0, 1)
    x, weight = np.stack([(at + 0.5) / BINS * 2 * REACH - REACH, np.ones(BINS)], 1), unlabelled / unlabelled.sum() * 1000
    a = np.array([1.0, 0.0])
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (weight * (guess - share)) + 0.1 * (a - [1.0, 0.0])
        a = a - np.linalg.solve((x * (weight * guess * (1 - guess))[:, None]).T @ x + 0.1 * np.eye(2), slope)
    return float(max(a[0], 1e-3)), float(a[1])


def texts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            yield [t or "" for t in whole.slice(i, BATCH)["text"].to_pylist()]


def counted(docs: DataFrame) -> np.ndarray:
    """COUNTS over all texts. Each task adds up its own and sends them in blocks, which are added up as they arrive."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-COUNTS // BLOCK) * BLOCK, np.int64)
        for texts in texts_in(batches):
            (_, words), (_, grams) = hashed(texts)
            single, pairs, sizes = classes_of(texts)
            total[:WORDS] += np.bincount(words, minlength=WORDS)
            total[WORDS : WORDS + GRAMS] += np.bincount(grams, minlength=GRAMS)
            total[WORDS + GRAMS : COUNTS] += np.concatenate([single.sum(0), pairs.sum(0), [sizes.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) // BLOCK), pa.int32()), pa.array([b.tobytes() for b in total.reshape(-1, BLOCK)], pa.binary())], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["at"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())], ["at", "counts"])

    schema, out = "at int, counts binary", np.zeros(-(-COUNTS // BLOCK) * BLOCK, np.int64)
    for at, counts in docs.mapInArrow(count, schema).repartition(shuffle_partitions(docs.sparkSession), "at").mapInArrow(add, schema).collect():  # COUNTS / BLOCK rows
        out[at * BLOCK : (at + 1) * BLOCK] = np.frombuffer(counts, np.int64)
    return out[:COUNTS]


def products(docs: DataFrame, content: Content | None = None) -> np.ndarray:
    """Sums of the products of all pairs of features over all texts; the last is the number of texts.

    Each task sends one row for each pair, so what is shuffled does not depend on the texts.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES))
        for texts in texts_in(batches):
            x = features(texts, content)
            total += x.T @ x
        i, j = np.triu_indices(FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((FEATURES, FEATURES))
    for i, j, v in docs.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # FEATURES ** 2 / 2 rows
        out[i, j] = out[j, i] = v
    return out


def margin_counts(docs: DataFrame, weights: np.ndarray, content: Content | None = None) -> np.ndarray:
    """Models by BINS: how many of all texts have a margin in a bin."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros((len(weights), BINS), np.int64), np.arange(len(weights))
        for texts in texts_in(batches):
            at = model[None, :] * BINS + binned(features(texts, content) @ weights.T)
            total += np.bincount(at.ravel(), minlength=total.size).reshape(total.shape)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], ["k", "b", "n"])

    out = np.zeros((len(weights), BINS))
    for k, b, n in docs.mapInArrow(add, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n")).collect():  # models * BINS rows
        out[k, b] = n
    return out


def sampled_positives(labels: DataFrame, positives: int) -> DataFrame:
    """doc_id and share (0 to 1) of about `positives` rows of label 1, by a hash of the id."""
    share = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    n = labels.count()
    return labels.withColumn("share", share / min(1.0, positives / max(n, 1))).where("share < 1").select("doc_id", "share")


def positive_features(docs: DataFrame, some: DataFrame, content: Content) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sampled positives, and the share of each."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                yield pa.RecordBatch.from_arrays([batch["share"], pa.array([row.tobytes() for row in features(batch["text"].to_pylist(), content)], pa.binary())], ["share", "x"])

    found = docs.join(F.broadcast(some), "doc_id").select("text", "share").mapInArrow(extract, "share double, x binary").toPandas()  # about `positives` rows
    return np.frombuffer(b"".join(found["x"]), np.float64).reshape(len(found), FEATURES), found["share"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Model | None:
    """A model of label 1 from docs (doc_id, text) and labels (doc_id, label); rows with a null are left out.

    Only labels 1 are used, of a bounded sample of about `positives` texts, of which one part gives
    the weights and one the prior, the calibration and the support; repeated rows and labels count as often as they come.
    Unlabelled are all texts of docs. None without a positive or a text. Of so few positives that a part has none, all
    serve for it.
    """
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).na.drop().where("label = 1").select("doc_id")
    docs = docs.select("doc_id", "text").na.drop()
    some = sampled_positives(labels, positives)
    content = Content.of(counted(docs.select("text")))
    x, share = positive_features(docs, some, content)
    if not len(x):
        return None
    first, rest = x[share < FITTED], x[share >= FITTED]
    first, rest = (part if len(part) else x for part in (first, rest))
    total = products(docs.select("text"), content)
    of_u, of_p = total / total[-1, -1], first.T @ first / len(first)
    scale = np.sqrt(np.maximum(np.diag(of_u) - of_u[-1] ** 2, 1e-6))
    scale[-1] = 1.0
    change = np.diag(1 / scale)
    change[:-1, -1] = -of_u[-1, :-1] / scale[:-1]  # features less their means, in standard deviations
    of_u, of_p = change @ of_u @ change.T, change @ of_p @ change.T
    ridge = FEATURES / (2 * len(first))
    against = np.linalg.solve((of_p + of_u) / 2 + ridge * np.eye(FEATURES), (of_p[-1] - of_u[-1]) / 2)
    weights = np.stack([against, *(minimise_risk(of_p, of_u, prior, ridge) for prior in PRIORS)]) @ change
    counts = margin_counts(docs.select("text"), weights, content)
    own = np.stack([np.bincount(binned(rest @ w), minlength=BINS) for w in weights])
    prior = estimate_prior(own[0], counts[0])
    chosen = 1 + int(np.abs(PRIORS - prior).argmin())
    return Model(weights[chosen], *calibrate(own[chosen], counts[chosen], prior), prior, content, support_of(rest))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null texts count as empty, which have a score as well; without a model every score is 0.5. Columns named score or
    predicted, in either letter case, are replaced. Rows are independent, so repeated rows, ties and null ids need no
    care: equal texts have equal scores. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, (text,) = besides(docs, "score", "predicted"), unused(docs, "scored_text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                score = shared.value.score(features(texts, shared.value.content)) if shared.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    rows = docs.select(*quoted(kept), F.col(text_col).alias(text))
    return rows.mapInArrow(apply, ", ".join(filter(None, [schema_of(docs, kept), "score double", "predicted int"])))
