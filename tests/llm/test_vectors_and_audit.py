"""Whitening, near vectors and the filter audit against plain versions."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from tallybook.llm import embedding_dedup, filter_audit, spectrum, whitening

CLASHING = "digest vector entries key keys n members x component deviation LABELLED mask good least words".split()


def plain_eigen(matrix, count):
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1][:count], vectors[:, ::-1][:, :count]


@pytest.mark.parametrize("dims,count", [(1, 3), (2, 2), (5, 5), (40, 16)])
def test_eigenpairs(dims, count):
    draw = np.random.default_rng(dims)
    x = draw.normal(size=(300, dims)) * np.linspace(1, 3, dims)
    matrix = x.T @ x
    values, vectors = spectrum.leading_eigenpairs(matrix, count)
    assert np.allclose(values, plain_eigen(matrix, count)[0], rtol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(vectors @ matrix @ vectors.T, np.diag(values), atol=1e-9 * values[0])


@pytest.mark.parametrize("diagonal", [[1, 1, 1, 1], [0, 0, 0], [3, 3, 1, 0], [2, 2 - 1e-13, 1], [5, 4, 0, 0]])
def test_eigenpairs_of_clusters(diagonal):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(len(diagonal),) * 2))[0]
    values, vectors = spectrum.leading_eigenpairs(turn @ np.diag(np.array(diagonal, float)) @ turn.T, 4)
    assert np.allclose(values, sorted(diagonal, reverse=True)[:4], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)


def test_inertia_counts_every_shift():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(30, 12))
    matrix = np.round(x.T @ x)
    form = spectrum.tridiagonal(matrix)
    found = np.linalg.eigvalsh(matrix)
    for shift in [*np.linspace(-5, found[-1] + 5, 60), *np.diag(matrix), 0.0]:
        if np.abs(found - shift).min() > 1e-9:
            assert spectrum.eigenvalues_above(*form, shift) == (found > shift).sum()


def vector_rows(dims=6, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in draw.normal(size=dims) * np.linspace(1, 2, dims)], i % 3) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(30)]  # equal vectors
    rows += [(300 + i, [float(v) for v in np.array(rows[i][1]) * (i + 2) + 1e-3], rows[i][2]) for i in range(30)]  # all but parallel ones
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 2), (400, rows[0][1], 1), (401, rows[0][1], None)]  # a repeated row, a repeated id, other labels
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * dims, 1), (503, [1.0] * (dims - 1) + [None], 1), (504, [float("nan")] * dims, 1), (505, [float("inf")] + [1.0] * (dims - 1), 1)]
    rows += [(506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (508, [-0.0, 1e-200, 1.0][:dims] + [0.0] * (dims - 3), 2), (509, [0.0, 0.0, 1e200][:dims] + [0.0] * (dims - 3), 2), (None, rows[0][1], 0)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}_` string, `{c}` string" if c in ("component",) else f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHING) + 1)) for r in vector_rows()], schema).repartition(3)


def usable(v):
    return bool(v) and all(e is not None and np.isfinite(e) for e in v) and any(v)


def plain_links(rows, cosine):
    """Links and component of each row, by comparing all."""
    n = len(rows)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for _, v, _ in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and None not in (rows[i][0], rows[j][0]) and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    least = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                low = min(least[rows[i][0]], least[rows[j][0]])
                changed |= least[rows[i][0]] != low or least[rows[j][0]] != low
                least[rows[i][0]] = least[rows[j][0]] = low
    return sorted(((r[0], len(near[i]), least[r[0]], r[0] is not None and least[r[0]] == r[0]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 7])
def test_near_vectors(vectors, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    found = [tuple(r) for r in embedding_dedup.near_vectors(vectors, 0.98).collect()]
    assert sorted(found, key=str) == plain_links(vector_rows(), 0.98)


def test_near_vectors_of_one_tight_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(4)
    centre = draw.normal(size=32)
    rows = [(i, [float(v) for v in centre + 0.11 * draw.normal(size=32)], 1) for i in range(90)] + [(100 + i, [float(v) for v in draw.normal(size=32)], 1) for i in range(90)]
    found = [tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()]
    expected = plain_links([(i, [float(np.float32(e)) for e in v], k) for i, v, k in rows], 0.98)
    assert sorted(found, key=str) == expected and sum(r[1] for r in expected) > 1000


def test_near_vectors_of_nothing(vectors):
    assert embedding_dedup.near_vectors(vectors.limit(0)).collect() == []


@pytest.mark.parametrize("largest", [100, 100_000, 10**9])
def test_close_pairs_share_directions(largest):
    draw, pairs, dims = np.random.default_rng(9), 2000, 64
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in draw.normal(size=(2, pairs, dims)))
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    chance = 1.0
    for code in embedding_dedup.product_codes(dims, *embedding_dedup.plan_of_codes(largest)):
        one, other = embedding_dedup.decoded(u, code), embedding_dedup.decoded(v, code)
        chance *= np.mean(~(one[:, :, None] == other[:, None, :]).any((1, 2)))
    assert chance < 1e-5


def test_decoded_are_the_nearest_directions():
    draw = np.random.default_rng(2)
    units = draw.normal(size=(20, 9))
    rotation, blocks = embedding_dedup.product_codes(9, 1, 2, 12)[0]
    all_sums = (units @ rotation[:, :5] @ blocks[0].T)[:, :, None] + (units @ rotation[:, 5:] @ blocks[1].T)[:, None, :]
    expected = np.argsort(-all_sums.reshape(20, -1), axis=1)[:, : embedding_dedup.LISTED]
    assert np.array_equal(np.sort(embedding_dedup.decoded(units, (rotation, blocks)), 1), np.sort(expected, 1))


def test_whitening(vectors):
    rows = [r for r in vector_rows() if r[1] and len(r[1]) == 6 and all(e is not None and np.isfinite(e) and abs(e) < 1e9 for e in r[1])]
    found = whitening.whitened_vectors(vectors.where("vec_id is null or vec_id not in (508, 509)"), components=4).collect()
    rows = [r for r in rows if r[0] not in (508, 509)]
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, turn = plain_eigen(centred.T @ centred / n, 4)
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    white = (x - total / n) @ turn / np.sqrt(values)
    expected = sorted(((str(r[0]), k + 1, int(((n * x[i] - total) ** 2).sum()), round(abs(white[i, k]), 8)) for i, r in enumerate(rows) for k in range(4)), key=str)
    assert sorted(((str(r["vec_id"]), r["component"], r["deviation"], round(abs(r["whitened"]), 8)) for r in found), key=str) == expected
    share = values / np.trace(centred.T @ centred / n)
    assert all(abs(r["explained"] - share[r["component"] - 1]) < 1e-12 for r in found)


def test_whitening_of_little(spark, vectors):
    assert whitening.whitened_vectors(vectors.limit(0)).collect() == []
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened_vectors(few).collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in whitening.whitened_vectors(line).collect()) == [(1, 1, 1.0), (2, 1, 1.0)]


def plain_measures(text: str):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(found), len(set(found)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def test_transducer(rows):
    draw = random.Random(5)
    texts = [t or "" for _, t in rows] + ["".join(draw.choices("aB é日 \t\n#\x0b\x1f\x85 🎉", k=draw.randrange(400))) for _ in range(200)]
    texts += ["", "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", " ".join(["a" * 64, "a" * 64 + "b", "a" * 64 + "c"] * 5), "\0 \0\0 \0"]
    found = filter_audit.transduced([t.encode() for t in texts])
    assert list(zip(*(found[m].tolist() for m in filter_audit.MEASURES))) == [plain_measures(t) for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "_hashed", lambda data, starts, sizes, seed: np.zeros(len(starts), np.uint64))
    texts = ["a b a c ab abc", "b a", "", "longer-than-eight longer-than-nine! " * 3 + "z" * 80 + " " + "z" * 81]
    assert filter_audit.transduced([t.encode() for t in texts])["distinct"].tolist() == [plain_measures(t)[1] for t in texts]


def plain_audit(rows, labels):
    masks, out = [], {}
    for i, text, lang in rows:
        text = text or ""
        words, distinct, capitals, points, symbols = plain_measures(text)
        copies = [j for j, other, _ in rows if (other or "") == text and j is not None]
        fails = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, i is not None and min(copies) < i]
        good, toxic = (any(d == i and d is not None and row[k] == 1 for d, *row in labels) for k in (0, 1))
        masks.append((lang or "", [f for f, bad in zip("ABCDE", fails, strict=True) if bad], good, toxic))
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        first = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                at = [m for m in own if not set(m[1]) & set(order[:k])]
                gone = [m for m in at if f in m[1]]
                first[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(at) - len(gone), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == [f] for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(first[order[step - 1]])
    return out


def test_filter_audit(spark, awkward, rows):
    langs = [None, "en", "fr"]
    documents = [(i, t, langs[k % 3]) for k, (i, t) in enumerate(rows)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (40, 1, None), (None, 1, 1), (999, 1, 1), (8, 1, 1)]
    table = spark.createDataFrame([(*d, *["x"] * len(CLASHING)) for d in documents], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)
    found = filter_audit.filter_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in found} == plain_audit(documents, labels)
    assert len(found) == 3 * 600


def test_filter_audit_of_nothing(spark, nothing):
    assert filter_audit.filter_audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
