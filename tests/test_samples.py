"""Stored samples of uploads, and previews from them."""

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.plans import preview, samples, scenario
from tallybook.sources.history import History, Upload, history_view

COLUMNS = {"k": "int", "d": "date", "x": "float"}


def upload(spark, folder, seq, rows, period=None, policy=None):
    path = f"{folder}/u{seq}"
    df = rows.select(F.col("k").cast("long").alias("k"), F.to_date("d").alias("d"), F.col("x").cast("double").alias("x"))
    df.withColumns({"_upload_id": F.lit(f"u{seq}"), "_upload_seq": F.lit(seq), "_row": F.monotonically_increasing_id(), "_month": F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("none"))}).write.partitionBy("_month").parquet(path)
    return Upload(f"u{seq}", seq, path, period and Period.read(period), policy=policy)


def month(spark, n, keys, day, null_every=0):
    k = F.when(F.col("id") % null_every == 0, None).otherwise(F.col("id") % keys) if null_every else F.col("id") % keys
    return spark.range(n).select(k.alias("k"), F.lit(day).alias("d"), (F.col("id") * 1.0).alias("x"))


def bag(df):
    return Counter(tuple(r) for r in df.select("k", "d", "x").collect())


def test_cut():
    assert samples.cut({}, 10) == 0 and samples.cut({-5: 4, -1: 6}, 10) == 0
    assert samples.cut({-5: 4, -1: 7}, 10) == -2  # all places below the one that is too much are whole
    assert samples.cut({-5: 40, -1: 7}, 10) == -5  # the first one stays, whatever it holds
    assert samples.cut({-9: 1, -5: 40, -1: 7}, 10) == -6
    assert samples.rate(0) == 1 and samples.rate(-1) == 1 and samples.rate(-65) == 0.5


def test_samples_of_uploads_are_the_sample_of_the_history(spark, tmp_path):
    uploads = [upload(spark, tmp_path, 1, month(spark, 6000, 1500, "2024-01-10", 7), "2024-01"), upload(spark, tmp_path, 2, month(spark, 9000, 3000, "2024-02-10"), "2024-02"), upload(spark, tmp_path, 3, month(spark, 50, 50, "2024-01-20"), "2024-01")]
    source = History(uploads, COLUMNS, "d")
    found = samples.joint(spark, str(tmp_path / "store"), {"s": source}, {"s": ["k"]}, 2000)
    whole = history_view(spark, source)
    upto = max(r[0] for r in found.tables["s"].select(samples.place(found.tables["s"], ["k"])).collect())
    assert 0 < found.rate < 0.5 and bag(found.tables["s"]) == bag(whole.where(samples.place(whole, ["k"]) <= upto))
    assert found.tables["s"].count() <= 2000
    assert found.error < 0.2


def test_what_is_stored_is_not_read_again(spark, tmp_path):
    one, two = upload(spark, tmp_path, 1, month(spark, 4000, 4000, "2024-01-10")), upload(spark, tmp_path, 2, month(spark, 4000, 4000, "2024-02-10"))
    store, keys = str(tmp_path / "store"), {"s": ["k"]}
    first = samples.joint(spark, store, {"s": History([one], COLUMNS, "d")}, keys, 1000).tables["s"].count()
    shutil.rmtree(one.path)
    both = samples.joint(spark, store, {"s": History([one, two], COLUMNS, "d")}, keys, 1000)
    assert 0 < both.tables["s"].where("_upload_seq = 1").count() < first
    assert Counter(r.k for r in both.tables["s"].where("_upload_seq = 1").collect()) == Counter(r.k for r in both.tables["s"].where("_upload_seq = 2").collect())


@pytest.mark.parametrize("n", [0, 1, 900])
def test_small_uploads_are_whole(spark, tmp_path, n):
    source = History([upload(spark, tmp_path, 1, month(spark, n, 10, "2024-01-10")), upload(spark, tmp_path, 2, month(spark, 0, 10, "2024-01-10"))], COLUMNS, "d", "append")
    if n == 0:
        source = History([], COLUMNS, "d")
    found = samples.joint(spark, str(tmp_path / "store"), {"s": source}, {"s": ["k"]}, 1000)
    assert found.rate == 1 and found.error < 1e-9 and found.tables["s"].count() == n


def test_hot_keys_stay_together(spark, tmp_path):
    rows = month(spark, 3000, 3000, "2024-01-10").withColumn("k", F.when(F.col("k") < 1000, -1).otherwise(F.col("k")))
    found = samples.joint(spark, str(tmp_path / "store"), {"s": History([upload(spark, tmp_path, 1, rows)], COLUMNS, "d")}, {"s": ["k"]}, 500)
    assert found.tables["s"].where("k = -1").count() in (0, 1000)
    assert found.error > 0.05 or found.tables["s"].where("k = -1").count() == 0


def test_rows_replaced_by_keys(spark, tmp_path):
    uploads = [upload(spark, tmp_path, 1, month(spark, 3000, 3000, "2024-01-10")), upload(spark, tmp_path, 2, month(spark, 3000, 2000, "2024-02-10"))]
    source = History(uploads, COLUMNS, "d", "merge_dedupe", ["k"])
    assert samples.suits(source, ["k"]) and not samples.suits(source, ["x"]) and not samples.suits(source, [])
    found = samples.joint(spark, str(tmp_path / "store"), {"s": source}, {"s": ["k"]}, 700)
    assert found.tables["s"].count() == found.tables["s"].select("k").distinct().count()
    assert found.tables["s"].where("k < 2000 and _upload_seq = 1").count() == 0


def test_previews(spark, tmp_path):
    source = History([upload(spark, tmp_path, 1, month(spark, 30000, 10000, "2024-01-10"))], COLUMNS, "d")
    other = spark.range(20000).select((F.col("id") / 1.0).alias("key"), F.lit(2.0).alias("y"), F.col("id").alias("k"))
    steps = [{"type": "dedupe", "by": ["k"], "newest": ["x"]}, {"type": "join", "with": "b", "on": {"k": "key"}}]
    plan = scenario.Scenario({"a": {"source": "s", "steps": steps}, "b": {"source": "t"}})
    rows, counts = preview.stored_preview(spark, plan, {"s": source, "t": other}, "a", Period.read("2024"), str(tmp_path / "store"), 10, 6000)
    assert len(rows) == 10 and all(r["y"] == 2.0 for r in rows)  # keys of other types and names are sampled alike
    assert [c.step for c in counts] == ["source", "dedupe", "join"] and not any(c.exact for c in counts)
    assert abs(counts[0].rows - 30000) < 1500 and all(abs(c.rows - 10000) < 500 for c in counts[1:]) and counts[0].error < 0.05


def test_a_join_by_other_columns_needs_its_table_whole(spark, tmp_path):
    source = History([upload(spark, tmp_path, 1, month(spark, 9000, 9000, "2024-01-10"))], COLUMNS, "d")
    other = spark.range(9000).select((F.col("id") * 1.0).alias("x"), F.col("id").alias("k"), F.lit(1).alias("y"))
    for steps in ([{"type": "dedupe", "by": ["k"], "newest": ["x"]}, {"type": "join", "with": "b", "on": ["x"], "columns": ["y"]}], [{"type": "formula", "name": "z", "text": "x + 0"}, {"type": "join", "with": "b", "on": {"z": "x"}, "columns": ["y"]}]):
        plan = scenario.Scenario({"a": {"source": "s", "steps": steps}, "b": {"source": "t"}})
        rows, counts = preview.stored_preview(spark, plan, {"s": source, "t": other}, "a", Period.read("2024"), str(tmp_path / "store"), 5000, 1000)
        assert rows and all(r["y"] == 1 for r in rows) and not counts[0].exact
