"""The contract queries: the digest columns of each against plain versions, over a small folder of tables."""

import hashlib
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from awkward_tables import awkward_rows, edited, words
from test_dedup import brute_components, brute_repeats, shingles
from test_operators import TONGUES, brute_spans, prose, token_ids

from tallybook.llm import queries
from tallybook.llm.byte_bpe import load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Awkward rows with ids of their own, prose in three languages, copies, and texts of low quality."""
    found = [(i, t, None) for i, (_, t) in enumerate(awkward_rows(), 1)]
    found += [(1000 + i, prose(lang, i), lang) for i, lang in enumerate(list(TONGUES) * 60)]
    found += [(2000 + i, edited(found[200][1], 40, i), None) for i in range(5)]
    found += [(3000 + i, " | ".join(w.upper() + "!!" for w in words(i, 60).split()), None) for i in range(60)]
    return found


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    labels = [(i, int(i < 3000), 0) for i, _, _ in rows if 1000 <= i < 2000 or i >= 3000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def run(spark, folder, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == [*range(1, 14)]


def test_op1(spark, folder, rows):
    got = run(spark, folder, "op1_secret_scan")
    for i, text, _ in rows:
        base, spans = brute_spans(text)
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (got[i].base_sha256, got[i].spans) == (sha(base), spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))


@pytest.mark.parametrize("name", ["op1_secret_scan", "op6_exact_dedup"])
def test_oracles(spark, folder, rows, name):
    got = run(spark, folder, name)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, row)) for row in cursor.fetchall()]
    assert len(want) == len(rows) == len(got) and all(got[w["doc_id"]].asDict() == w for w in want)


def test_op2(spark, folder, rows):
    got, least = run(spark, folder, "op2_minhash_dedup"), brute_components([(i, t) for i, t, _ in rows], 85)
    assert {i: (r.component_id, r.kept, r.n_shingles) for i, r in got.items()} == {i: (least[i], least[i] == i, len(shingles(t))) for i, t, _ in rows}


def test_op3(spark, folder, rows):
    got = run(spark, folder, "op3_suffix_dedup")
    for i, size, spans, kept in brute_repeats([(i, t) for i, t, _ in rows], 100):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(kept), len(spans), sha(kept))


def test_op5(spark, folder, rows):
    ids = {i: token_ids(t) for i, t, _ in rows}
    covered, used = {i: 0 for i in ids}, {}
    for r in queries.op5_packing(spark, folder).orderBy("doc_id", "start").collect():
        assert (r.start, r.doc_tokens) == (covered[r.doc_id], len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
        covered[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(parts[-1]) <= 2048
    assert len(used) == -(-sum(covered.values()) // 2048)


def test_op7(spark, folder, rows):
    got = run(spark, folder, "op7_language_id")
    for i, text, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    held = [(i, lang) for i, _, lang in rows if lang and got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held) > 30


def test_op8(spark, folder, rows):
    got = run(spark, folder, "op8_quality")
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    held = [i for i in got if got[i].held_out and (1000 <= i < 2000 or i >= 3000)]
    assert sum(got[i].predicted == int(i < 3000) for i in held) >= 0.97 * len(held) > 30


def test_op9(spark, folder, rows):
    got = run(spark, folder, "op9_mpeg_audio")
    by_text = {}
    for i, text, _ in rows:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:]))
        assert by_text.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op10(spark, folder, rows):
    got, encoding = run(spark, folder, "op10_byte_bpe"), load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text, _ in rows:
        ids = encoding.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def test_op4(spark, folder, rows):
    from test_pseudonyms import plain_text

    got = run(spark, folder, "op4_pii")
    for i, text, _ in rows:
        fresh, spans = plain_text(text or "")
        assert (got[i].text or "", got[i].changed) == (fresh, bool(spans))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
