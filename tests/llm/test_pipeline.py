"""The pipeline's stages, each judged on its own input against a plain version."""

import re
from collections import defaultdict

import pytest
from awkward_tables import edited, words
from test_dedup import brute_components
from test_operators import TONGUES, brute_spans, prose

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, i), lang) for i, lang in enumerate(list(TONGUES) * 120)]
    rows += [(1000 + i, rows[i][1].replace(" ", "  ", 5), rows[i][2]) for i in range(0, 60, 2)]  # exact copies, but for spaces
    rows += [(2000 + i, edited(rows[i][1], 60, i), rows[i][2]) for i in range(100, 130)]
    rows += [(3000 + i, rows[i][1] + f' token = "{i:020d}" password=short7 login: a{i}@example.com', rows[i][2]) for i in range(200, 220)]
    rows += [(4000, None, None), (4001, "", "aa"), (4002, "1234 5678", None), (4003, "zzxq jjkw vvpf " * 40, None), (4004, words(3, 5), None)]
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3)
    return table


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Input and output rows of every stage, written and read again in between."""
    folder, out, current = tmp_path_factory.mktemp("stages"), [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, "").write.parquet(str(folder / name))
        written = spark.read.parquet(str(folder / name))
        out.append((name, current.columns, current.collect(), written.columns, written.collect()))
        current = written
    return {name: rest for name, *rest in out}


def test_order_and_columns(stages):
    assert list(stages) == ["language_id", "exact_dedup", "minhash_dedup", "secret_scan", "packing"]
    for name, (_, _, columns, _) in stages.items():
        assert columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") or name == "packing"


def test_language_stage_keeps_prose(stages):
    _, before, _, after = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {4000, 4001, 4002, 4003} <= gone <= {4000, 4001, 4002, 4003, 4004}
    lang = {r.doc_id: r.lang for r in before}
    assert all(r.lang == lang[r.doc_id] for r in after if r.doc_id < 360)


def test_exact_stage(stages):
    _, before, _, after = stages["exact_dedup"]
    least = {}
    for r in before:
        text = re.sub("[ \t-\r]+", " ", r.text)
        least[text] = min(r.doc_id, least.get(text, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values()) and len(after) < len(before)


def test_near_stage(stages):
    _, before, _, after = stages["minhash_dedup"]
    least = brute_components([(r.doc_id, r.text) for r in before], 80)
    assert sorted(r.doc_id for r in after) == sorted({*least.values()}) and len(after) < len(before)


def test_secret_stage_masks(stages):
    _, before, _, after = stages["secret_scan"]
    masked = {r.doc_id: r.text for r in after}
    assert len(before) == len(after)
    for r in before:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(r.text)[1].split(",") if s]
        merged = []
        for start, end in sorted(spans):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        want, at = "", 0
        for start, end in merged:
            want, at = want + r.text[at:start] + "[SECRET]", end
        assert masked[r.doc_id] == want + r.text[at:]


def test_packing_stage(stages):
    _, before, _, after = stages["packing"]
    total, done = {}, defaultdict(int)
    for p in after:
        total[p.doc_id] = p.doc_tokens
        done[p.doc_id] += p.length
    assert set(total) == {r.doc_id for r in before} and all(done[i] == n for i, n in total.items())


def test_run_is_the_stages(spark, docs, tmp_path, stages):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.doc_tokens) for r in got.collect()} == {(r.doc_id, r.doc_tokens) for r in stages["packing"][3]}


def test_language_stage_keeps_columns_of_any_name(spark, docs):
    """Columns with the model's own names, dots and marks come back with their values; ids may be null and rows repeated."""
    extra = {"score": "own score", "Rejected": "no", "lang_pred": "xx", "cross_entropy": "high", "a.b": "dotted", "c0": "zero", "back`tick": "t"}
    wide = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", corpus_pipeline.F.lit(None).cast("long")))
    wide = wide.select("*", *(corpus_pipeline.F.lit(v).alias(k) for k, v in extra.items()))
    kept = corpus_pipeline.keep_identified(spark, wide, "")
    assert kept.columns == wide.columns and kept.dtypes == wide.dtypes
    rows = kept.collect()
    assert all(r[k] == v for r in rows for k, v in extra.items())
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    again = corpus_pipeline.drop_similar(spark, corpus_pipeline.drop_copies(spark, kept, ""), "")
    assert again.columns == wide.columns and {r["a.b"] for r in corpus_pipeline.mask_secrets(spark, again, "").collect()} == {"dotted"}
