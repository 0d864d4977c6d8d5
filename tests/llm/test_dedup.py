"""Exact, near and suffix deduplication against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from awkward_tables import edited, words

from tallybook.llm import minhash
from tallybook.llm.components import connected_components
from tallybook.llm.exact_dedup import drop_exact_copies, exact_dedup
from tallybook.llm.minhash import drop_near_copies, near_duplicates
from tallybook.llm.suffix_dedup import remove_repeats

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(zip(*(found[i:] for i in range(5)))) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def brute_components(rows, percent):
    """Smallest reachable id by plain comparison of all pairs with an id."""
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in named}
    change = True
    links = [(a, b) for a, s in named for b, t in named if s and t and 100 * len(s & t) >= percent * len(s | t)]
    while change:
        change = False
        for a, b in links:
            if least[b] < least[a]:
                least[a], change = least[b], True
    return least


def test_exact_groups(awkward, rows):
    norm = [(i, re.sub("[ \t-\r]+", " ", t or "")) for i, t in rows]
    size = Counter(t for _, t in norm)
    keep = {}
    for i, t in norm:
        if i is not None:
            keep[t] = min(keep.get(t, i), i)
    want = Counter((i, keep.get(t), size[t], i is not None and i == keep.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter(map(tuple, exact_dedup(awkward).collect())) == want


def test_exact_kept_rows_have_all_columns(awkward):
    kept = drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 10} and 2 not in {r.doc_id for r in kept.collect()}


def test_exact_copies_are_rows_not_ids(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "c", "x"), (2, "a b", "x"), (2, "d", "x"), (3, "e", "x"), (3, "e", "x"), (3, "e", "x")]
    rows += [(None, "f", "x"), (None, "f", "x"), (None, "f", "y"), (None, "c", "x"), (None, "g", None), (None, None, None), (4, "", None)]
    kept = drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(((r.doc_id or 9, " ".join((r.text or "").split())) for r in kept)) == [(1, "a b"), (1, "c"), (2, "d"), (3, "e"), (4, ""), (9, "f"), (9, "g")]
    assert all(tuple(r) in rows for r in kept)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components(awkward, rows, percent):
    least = brute_components(rows, percent)
    got = near_duplicates(awkward, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == least.get(r.doc_id), r
        assert r.kept == (r.doc_id is not None and least[r.doc_id] == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)


@pytest.mark.parametrize("few", [2, 8])
def test_near_large_clusters_are_dealt_as_blocks(spark, monkeypatch, few):
    """Families of near copies that are far larger than a block, of which some only touch, give the same components."""
    base, other = words(7, 120), words(8, 120)
    rows = [(i, edited(base, 25 + i % 90, i)) for i in range(90)]
    rows += [(200 + i, edited(base[: len(base) // 2] + other[len(other) // 2 :], 30 + i, i)) for i in range(40)]
    rows += [(300 + i, edited(other, 60, i)) for i in range(40)] + [(400 + i, edited(base, 11 + i % 5, i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "STRIP", 5)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 85).collect()}
    assert got == brute_components(rows, 85)


def test_near_kept_rows(awkward):
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 4} & set(ids) and {7, 8, 10, 6} <= set(ids) and ids.count(None) == 3


def test_estimates_are_corrected():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 1 << 63, 400, np.uint64), draw.integers(0, 1 << 63, 400, np.uint64)
    for shared in (0, 200, 380):
        pair = [np.unique(a), np.unique(np.concatenate([a[:shared], b[shared:]]))]
        bits = minhash.packed_bits(minhash.minima(pair))
        assert abs(minhash.estimates(bits[:1], bits[1:])[0, 0] - shared / (800 - shared)) < 0.1


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 205), (205, 103), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 205: 100, 103: 100}


def brute_repeats(rows, depth):
    """Bytes in windows that also start earlier; rows of one id are one document, rows without id come last."""
    first = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in texts:
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, _), (order, raw) in zip(rows, texts):
        gone = bytearray(len(raw))
        for s in range(len(raw) - depth + 1):
            if first[raw[s : s + depth]] < (order, s):
                gone[s : s + depth] = b"\1" * depth
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(raw), tuple(spans), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeats(awkward, rows, hot):
    got = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in remove_repeats(awkward, hot=hot).collect()]
    assert Counter(got) == Counter(brute_repeats(rows, 100))


def test_empty_tables(nothing):
    for f in (exact_dedup, near_duplicates, remove_repeats, drop_exact_copies, drop_near_copies):
        assert f(nothing).count() == 0


def test_low_thresholds_find_their_pairs(spark):
    """Bands follow from the threshold; where no banding finds all pairs, the threshold is refused."""
    base = words(17, 80)
    rows = [(i, edited(base, 9 + i % 30, i)) for i in range(40)] + [(50 + i, words(60 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (30, 55):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, percent).collect()} == brute_components(rows, percent)
    with pytest.raises(ValueError, match="cannot be searched"):
        near_duplicates(docs, 2)


def test_hubs_are_joined_like_other_nodes(spark, monkeypatch):
    from tallybook.llm import components

    monkeypatch.setattr(components, "HUB", 2)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 40, 3)] + [(300 + i, 301 + i) for i in range(20)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(40)} | {i + 100: 0 for i in range(1, 40, 3)} | {300 + i: 300 for i in range(21)}
