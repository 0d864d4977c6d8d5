"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import besides, checkpointed, quoted, schema_of, unused

ORDER = 4
SPACE = 32
#: Documents of each language, about, from which models are fitted; chosen by a hash of the id, whole texts.
TRAIN_DOCS = 2000
#: Share of the sample that gives the counts; the rest calibrates.
FITTED = 0.75
#: Languages whose models stand side by side in one table of n-grams; more languages make more such tables.
TOGETHER = 64
#: Stretches of held-back texts that a limit of cross-entropy lets pass, and how many a limit must be measured on.
KEPT, MEASURED = 0.9995, 2000
#: Levels of length: stretches of 2 ** level symbols.
LEVELS = 13
#: Width of the bins in which cross-entropies are counted, and their number.
BIN, BINS = 0.02, 1000
#: Numbers of symbols that a text's evidence may count for, of which the one that predicts held-back texts best is taken.
EVIDENCE = (5, 10, 20, 40, 80, 160)
BATCH = 64


@lru_cache(1)
def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its folded symbol (lower-case letters, marks as they are, else a space); which are letters."""
    points = range(0x110000)
    letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in points), bool, 0x110000)
    folded = np.full(0x110000, SPACE, np.uint32)
    at = np.flatnonzero(letter)
    folded[at] = [ord(chr(i).lower()[0]) for i in at.tolist()]
    folded[0x300:0x370] = np.arange(0x300, 0x370)
    return folded, letter


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded symbols of all texts, each behind ORDER - 1 spaces; starts, ends and numbers of letters of the texts.

    Runs of what is no letter become one space, and one space ends each text.
    """
    folded, letter = folding()
    pad = " " * (ORDER - 1)
    raw = np.frombuffer("".join(pad + t + " " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + ORDER for t in texts])
    starts = ends - [len(t) + ORDER for t in texts]
    found = folded[raw]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
    for i in range(ORDER - 1):
        keep[starts + i] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    letters = np.add.reduceat(letter[raw], starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return found[keep], place[starts] + ORDER - 1, place[ends], letters


def hashes(found: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the last `order` symbols up to each position; of fewer at the very start."""
    h = np.zeros(len(found), np.uint64)
    for i in range(order - 1, -1, -1):
        h[i:] = h[i:] * np.uint64(0x9E3779B97F4A7C15) + found[: len(found) - i]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(order)


@dataclass
class Tables:
    """Of up to TOGETHER languages: for each order, sorted hashes of n-grams with log-probabilities, and of contexts with
    log-weights, by language; floor is the log-probability of a symbol that no language has."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float


@dataclass
class Model:
    """The tables of all languages, in order of their names; limits of cross-entropy by language and level; evidence."""

    tables: list[Tables] = field(default_factory=list)
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, LEVELS)))
    evidence: int = EVIDENCE[0]

    @property
    def languages(self) -> list[str]:
        return [x for t in self.tables for x in t.languages]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram (ORDER folded characters) and n from columns text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                by: dict[str, list[str]] = {}
                for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    found, starts, ends, _ = symbols(texts)
                    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
                    _, first, n = np.unique(hashes(found, ORDER)[at], return_index=True, return_counts=True)
                    grams = found[at[first][:, None] + np.arange(1 - ORDER, 1)]
                    raw = np.ascontiguousarray(grams.astype("<u4")).tobytes().decode("utf-32-le", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([raw[k : k + ORDER] for k in range(0, len(raw), ORDER)], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return labelled.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimate(counts: pd.DataFrame, alphabet: int | None = None) -> Tables:
    """Interpolated Kneser-Ney: raw counts for the highest order, numbers of left neighbours below, one discount each.

    counts: lang, gram, n; alphabet: symbols that the languages have (those of counts, if not given). Below the single
    symbols lies an even chance of each symbol and of one more, for all that were never seen. Probabilities of every
    n-gram that any language of counts has are worked out for all of these, so that scoring looks up one row for each
    position.
    """
    languages = sorted(counts["lang"].unique())
    level = counts.assign(l=counts["lang"].map({x: i for i, x in enumerate(languages)}))[["l", "gram", "n"]]
    levels = [level]
    for _ in range(ORDER - 1):
        level = level.assign(gram=level["gram"].str[1:]).groupby(["l", "gram"], as_index=False).agg(n=("n", "size"))
        levels.insert(0, level)
    alphabet = alphabet or levels[0]["gram"].nunique()
    grams, contexts = [], []
    lower: pd.Series | None = None
    lower_p = np.full((1, len(languages)), 1.0)
    for k, level in enumerate(levels, 1):
        names = pd.Index(np.sort(level["gram"].unique()))
        c = np.zeros((len(names), len(languages)))
        c[names.get_indexer(level["gram"]), level["l"]] = level["n"]
        heads, head_of = np.unique(names.str[:-1].to_numpy(str) if k > 1 else np.zeros(len(names), int), return_inverse=True)
        total, types = np.zeros((len(heads), len(languages))), np.zeros((len(heads), len(languages)))
        np.add.at(total, head_of, c)
        np.add.at(types, head_of, c > 0)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        below = lower_p[lower.get_indexer(names.str[1:])] if k > 1 else np.full(c.shape, 1 / (alphabet + 1))
        seen = total[head_of] > 0
        p = np.where(seen, (np.maximum(c - discount, 0) + discount * types[head_of] * below) / np.maximum(total[head_of], 1), below)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        keys = _hash_of(names.tolist(), k)
        order = np.argsort(keys)
        grams.append((keys[order], np.log(p[order]).astype(np.float32)))
        keys = _hash_of(heads.tolist(), k - 1) if k > 1 else np.zeros(1, np.uint64)
        order = np.argsort(keys)
        contexts.append((keys[order], np.log(weight[order]).astype(np.float32)))
        lower, lower_p = names, p
    return Tables(languages, grams, contexts, float(-np.log(alphabet + 1)))


def _hash_of(names: list[str], order: int) -> np.ndarray:
    found = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    return hashes(found, order)[order - 1 :: order]


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key, and whether the key is there."""
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return at, table[0][at] == keys


def log_probabilities(tables: Tables, found: np.ndarray) -> np.ndarray:
    """Of each symbol (rows) behind those before it, under each language (columns)."""
    at, hit = look_up(tables.grams[-1], hashes(found, ORDER))
    logp = tables.grams[-1][1][at]
    unknown = np.flatnonzero(~hit)
    rest = np.zeros((len(unknown), len(tables.languages)), np.float32)
    where = np.arange(len(unknown))
    for k in range(ORDER - 1, -1, -1):  # weight of the context of order k, then the k-gram itself
        position = unknown[where]
        context = hashes(found, k)[np.maximum(position - 1, 0)] if k else np.zeros(len(position), np.uint64)
        at, hit = look_up(tables.contexts[k], context)
        rest[where[hit]] += tables.contexts[k][1][at[hit]]
        if not k:
            rest[where] += tables.floor
            break
        at, hit = look_up(tables.grams[k - 1], hashes(found, k)[position])
        rest[where[hit]] += tables.grams[k - 1][1][at[hit]]
        where = where[~hit]
    logp[unknown] = rest
    return logp


def costs(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of the nats of all symbols of all texts, by language; starts, ends and numbers of letters of the texts."""
    found, starts, ends, letters = symbols(texts)
    logp = np.concatenate([log_probabilities(t, found) for t in model.tables], axis=1)
    return np.concatenate([np.zeros((1, logp.shape[1])), np.cumsum(-logp, 0, dtype=np.float64)]), starts, ends, letters


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a symbol of each text (rows) under each language (columns); numbers of symbols and of letters."""
    sums, starts, ends, letters = costs(model, texts)
    n = ends - starts
    return (sums[ends] - sums[starts]) / np.maximum(n, 1)[:, None], n, letters


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of texts of n symbols: stretches as long as they or shorter were measured for it."""
    return np.minimum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), LEVELS - 1)


def measured(model: Model, rest: DataFrame) -> DataFrame:
    """kind, at and n from held-back texts (text, lang): what limits and evidence are taken from, in sums of bounded size.

    Of kind language * LEVELS + level: how many stretches of that length have a cross-entropy in bin `at` under the
    text's own language. Of kind -1: the loss of the prediction by EVIDENCE[at], in millionths of a nat.
    """
    shared = rest.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = {x: i for i, x in enumerate(shared.value.languages)}
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                sums, starts, ends, _ = costs(shared.value, batch["text"].to_pylist())
                own = np.array([languages[x] for x in batch["lang"].to_pylist()])
                kinds, bins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for language, start, end in zip(own.tolist(), starts.tolist(), ends.tolist()):
                    for level in range(LEVELS):
                        if (edges := np.arange(start, end + 1, 1 << level)).size < 2:
                            break
                        h = np.diff(sums[edges, language]) / (1 << level)
                        bins.append(np.minimum(h / BIN, BINS - 1).astype(np.int64))
                        kinds.append(np.full(len(h), language * LEVELS + level))
                both, n = np.unique(np.stack([np.concatenate(kinds), np.concatenate(bins)]), axis=1, return_counts=True)
                size = np.maximum(ends - starts, 1)[:, None]  # texts without a letter have no symbol
                h = (sums[ends] - sums[starts]) / size
                excess = h[np.arange(len(own)), own][:, None] - h
                loss = [int(np.logaddexp.reduce(excess * np.minimum(size, e), axis=1).sum() * 1e6) for e in EVIDENCE]
                kind, at = np.concatenate([both[0], np.full(len(EVIDENCE), -1)]), np.concatenate([both[1], np.arange(len(EVIDENCE))])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(np.concatenate([n, loss]))], ["kind", "at", "n"])

    return rest.mapInArrow(measure, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))


def calibrated(counts: np.ndarray) -> np.ndarray:
    """Limits by language and level from counts by language, level and bin; infinite where nothing was measured.

    The limit is the language's mean plus the excess over the mean that KEPT of the stretches of all languages stay
    below. Longer texts vary less, so a level with fewer than MEASURED stretches takes the excess of the one before.
    """
    middle = (np.arange(BINS) + 0.5) * BIN
    total = counts.sum(2)
    mean = np.where(total > 0, (counts @ middle) / np.maximum(total, 1), np.inf)
    excess = np.full(LEVELS, np.inf)
    for level in range(LEVELS):
        have = np.flatnonzero(total[:, level])
        if total[:, level].sum() >= MEASURED:
            shifted = (middle[None, :] - mean[have, level][:, None]).ravel()
            order = np.argsort(shifted)
            upto = np.cumsum(counts[have, level].ravel()[order])
            excess[level] = shifted[order][np.searchsorted(upto, KEPT * upto[-1])] + BIN
        elif level:
            excess[level] = excess[level - 1]
    usual = mean.copy()
    for level in range(1, LEVELS):
        usual[:, level] = np.where(total[:, level] > 0, mean[:, level], usual[:, level - 1])
    return usual + excess


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Models of the languages in labelled (doc_id, text, lang; rows with a null are left out), however many there are.

    Fitted on a bounded sample: about train_docs whole documents of each language, those whose hashed id is below
    train_docs / (documents of the language); repeated rows count as often as they come. FITTED of them give the counts,
    the rest the limits of rejection and the weight of the evidence. Where FITTED of them give no n-gram, as of rare
    labels, all documents of the language give the counts. A language without such a rest rejects nothing, of which a
    warning tells; one without any letter is not learned. An empty table gives a model of no language.
    """
    labelled = labelled.select("doc_id", "text", "lang").na.drop()
    totals = labelled.groupBy("lang").count().collect()  # one row for each language
    if not totals:
        return Model()
    total = F.create_map(*(F.lit(x) for row in totals for x in row))[F.col("lang")]
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) / 1_000_000
    bound = F.least(F.lit(1.0), F.lit(train_docs) / total)
    fitted = gram_counts(labelled.where(share < FITTED * bound).select("text", "lang"))
    if len(totals) > TOGETHER:
        fitted = checkpointed(fitted)
    names = sorted(row["lang"] for row in totals)
    split = {row["lang"] for row in fitted.select("lang").distinct().collect()} if len(totals) > TOGETHER else None
    parts: list[pd.DataFrame] = []
    for i in range(0, len(names), TOGETHER):
        some = names[i : i + TOGETHER]
        counts = (fitted.where(F.col("lang").isin(some)) if split is not None else fitted).toPandas()  # a bounded sample of TOGETHER languages
        if bare := sorted(set(some).difference(counts["lang"])):
            counts = pd.concat([counts, gram_counts(labelled.where(F.col("lang").isin(bare)).select("text", "lang")).toPandas()], ignore_index=True)
        if not counts.empty:
            parts.append(counts)
            split = (split or set()) | (set(counts["lang"]) - set(bare))
    if not parts:
        return Model()
    alphabet = len({c for part in parts for c in part["gram"].str[-1].unique()})
    model = Model([estimate(part, alphabet) for part in parts])
    rest = labelled.where((share >= FITTED * bound) & (share < bound) & F.col("lang").isin(sorted(split))).select("text", "lang")
    counts, loss = np.zeros((len(model.languages) * LEVELS, BINS)), np.zeros(len(EVIDENCE))
    for kind, at, n in measured(model, rest).collect():  # languages * LEVELS * BINS rows at most
        if kind < 0:
            loss[at] = n
        else:
            counts[kind, at] = n
    counts = counts.reshape(-1, LEVELS, BINS)
    model.limits = calibrated(counts)
    model.evidence = EVIDENCE[int(loss.argmin())]
    if unjudged := [x for x, seen in zip(model.languages, counts.sum((1, 2)) > 0, strict=True) if not seen]:
        warnings.warn(f"no texts held back, so none rejected, of languages {', '.join(unjudged)}", stacklevel=2)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score, cross_entropy and rejected.

    lang_pred is the language of the lowest cross-entropy a symbol (ties: the first by name), `und` for null texts,
    texts without a letter, and if no language was learned; those have score 0. score is the languages' share of the
    likelihood, over as many symbols as the model's evidence at most. rejected: `und`, or a text whose cross-entropy is
    above the limit of its language and length. Columns of these names, in either letter case, are replaced. Rows are
    independent, so repeated rows and null ids need no care; empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double, cross_entropy double, rejected boolean"
    names = [x.split()[0] for x in added.split(", ")]
    kept, (text,) = besides(docs, *names), unused(docs, "identified_text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, languages = shared.value, shared.value.languages
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                if not languages:
                    lang, score, best, out = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    h, n, letters = cross_entropies(m, texts)
                    at = h.argmin(1)
                    best = h[np.arange(len(h)), at]
                    score = np.where(letters > 0, 1 / np.exp(-(h - best[:, None]) * np.minimum(n, m.evidence)[:, None]).sum(1), 0.0)
                    out = (letters == 0) | (best > m.limits[at, level_of(n)])
                    lang = [languages[k] if c else "und" for k, c in zip(at.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score), pa.array(best), pa.array(out)], [*kept, *names])

    rows = docs.select(*quoted(kept), F.col(text_col).alias(text))
    return rows.mapInArrow(predict, ", ".join(filter(None, [schema_of(docs, kept), added])))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds
