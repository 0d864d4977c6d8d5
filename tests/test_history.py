"""Overlap policies, pruning and coverage of uploads."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.sources import history as H


def upload(spark, tmp_path, seq, rows, period, policy=None, schema="k string, d timestamp_ntz, x double"):
    df = spark.createDataFrame([(*r, f"u{seq}", seq, i) for i, r in enumerate(rows)], schema + ", _upload_id string, _upload_seq int, _row long")
    path = str(tmp_path / f"u{seq}")
    df.withColumn("_month", H.month_of("d")).write.partitionBy("_month").parquet(path)
    return H.Upload(f"u{seq}", seq, path, period and Period.read(period), policy=policy)


JAN, FEB, MAR = datetime(2024, 1, 10), datetime(2024, 2, 10), datetime(2024, 3, 10)
COLUMNS = {"k": "string", "d": "datetime", "x": "float"}


@pytest.fixture
def uploads(spark, tmp_path):
    return [
        upload(spark, tmp_path, 1, [("a", JAN, 1.0), ("b", FEB, 2.0), ("n", None, 3.0)], "2024-01-01..2024-02-29"),
        upload(spark, tmp_path, 2, [("b", FEB, 20.0), ("c", FEB, 21.0)], "2024-02"),
        upload(spark, tmp_path, 3, [("a", MAR, 30.0), (None, MAR, 31.0)], "2024-03"),
    ]


def values(spark, uploads, policy, span=None, keys=("k",)):
    return sorted(r.x for r in H.history_view(spark, H.History(uploads, COLUMNS, "d", policy, keys), span).collect())


def test_policies(spark, uploads):
    assert values(spark, uploads, "append") == [1, 2, 3, 20, 21, 30, 31]
    assert values(spark, uploads, "replace_period") == [1, 3, 20, 21, 30, 31]  # the row without a date stays
    assert values(spark, uploads, "replace_all") == [30, 31]
    assert values(spark, uploads, "merge_dedupe") == [3, 20, 21, 30, 31]


def test_ask(spark, uploads):
    with pytest.raises(ValueError, match="overlaps"):
        values(spark, uploads, "ask")
    chosen = [uploads[0], H.Upload("u2", 2, uploads[1].path, uploads[1].period, policy="merge_dedupe"), uploads[2]]
    assert values(spark, chosen, "ask") == [1, 3, 20, 21, 30, 31]


def test_bounds_prune_months(spark, uploads):
    span = (date(2024, 2, 1), date(2024, 3, 1))
    history = H.History(uploads, COLUMNS, "d")
    view = H.history_view(spark, history, span)
    assert sorted(r.x for r in view.collect()) == [20, 21]
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan


def test_bounds_do_not_bring_back_rows_of_moved_keys(spark, tmp_path):
    """Under ask, the second upload moves a to February; January must not show the first upload's a again."""
    one = upload(spark, tmp_path, 1, [("a", JAN, 1.0), ("b", JAN, 2.0)], "2024-01")
    two = upload(spark, tmp_path, 2, [("a", FEB, 10.0)], "2024-01-01..2024-02-29", policy="merge_dedupe")
    january = (date(2024, 1, 1), date(2024, 2, 1))
    assert values(spark, [one, two], "ask") == [2, 10]
    assert values(spark, [one, two], "ask", january) == [2] == values(spark, [one, two], "merge_dedupe", january)


def test_columns_that_came_later(spark, tmp_path):
    old = upload(spark, tmp_path, 1, [("a", JAN, "1.5")], "2024-01", schema="k string, d timestamp_ntz, x string")
    new = H.History([old], COLUMNS | {"y": "int"}, "d")
    assert [(r.x, r.y) for r in H.history_view(spark, new).collect()] == [(1.5, None)]


def test_coverage(uploads):
    history = H.History([uploads[0], H.Upload("u9", 9, "", Period.read("2024-05"))], COLUMNS, "d")
    assert H.coverage(history) == [(date(2024, 1, 1), date(2024, 3, 1)), (date(2024, 5, 1), date(2024, 6, 1))]
    assert H.gaps(history) == [(date(2024, 3, 1), date(2024, 5, 1))]
    assert H.gaps(history, (date(2024, 2, 1), date(2024, 7, 1))) == [(date(2024, 3, 1), date(2024, 5, 1)), (date(2024, 6, 1), date(2024, 7, 1))]
    assert H.default_report_period(history).code == "2024-05"
    assert [u.id for u in H.uploads_in(history, (date(2024, 2, 1), date(2024, 3, 1)))] == ["u1"]


def test_period_of_data(spark, uploads):
    df = spark.read.parquet(uploads[0].path)
    assert H.upload_period(df, "d", "month").unit == "range" and H.upload_period(df.where("k = 'a'"), "d", "month").code == "2024-01"
    assert H.upload_period(df.where(F.lit(False)), "d", "month") is None
    assert H.rows_outside(df, "d", Period.read("2024-01")).first().rows_outside == 1


def test_uploads_that_a_span_shows(spark):
    made = lambda policy, *periods: H.History([H.Upload(f"u{i}", i, "", p and Period.read(p), policy=how) for i, (p, how) in enumerate(periods)], COLUMNS, "d", policy)
    shown = lambda history, *span: [u.id for u in H.uploads_in(history, span)]
    first = (date(2024, 1, 1), date(2024, 4, 1))
    layers = (("2024", None), ("2024-01-01..2024-02-29", None), ("2024-03", None))
    assert shown(made("replace_period", *layers), *first) == ["u1", "u2"]
    assert shown(made("replace_period", *layers), date(2024, 1, 1), date(2024, 4, 2)) == ["u0", "u1", "u2"]
    assert shown(made("append", *layers), *first) == ["u0", "u1", "u2"] == shown(made("merge_dedupe", *layers), *first)
    assert shown(made("replace_all", *layers), *first) == ["u2"] and shown(made("replace_all", *layers), None, date(2024, 2, 1)) == []
    chosen = (("2024-01", None), ("2024-01", "replace_period"), (None, None), ("2024-01-10..2024-01-12", "merge_dedupe"))
    assert shown(made("ask", *chosen), *first) == ["u1", "u3"]


def test_periods_that_come_with_uploads(spark, tmp_path):
    """Rows take the declared period's first day, also after the declaration has changed; uploads are in or out as a whole."""
    one = upload(spark, tmp_path, 1, [("a", JAN, 1.0), ("b", None, 2.0)], "2024-05")
    two = upload(spark, tmp_path, 2, [("a", JAN, 3.0)], "2024-06")
    again = upload(spark, tmp_path, 3, [("c", FEB, 4.0)], "2024-06")
    none = upload(spark, tmp_path, 4, [("d", FEB, 5.0)], None)
    history = H.History([one, two, again, none], COLUMNS, "d", by_upload=True)
    seen = lambda span=None: sorted((r.x, r.d and r.d.date()) for r in H.history_view(spark, history, span).collect())
    assert seen() == [(1.0, date(2024, 5, 1)), (2.0, date(2024, 5, 1)), (4.0, date(2024, 6, 1)), (5.0, None)]
    assert seen((date(2024, 5, 1), date(2024, 6, 1))) == [(1.0, date(2024, 5, 1)), (2.0, date(2024, 5, 1))]
    assert seen((date(2024, 5, 2), date(2024, 6, 1))) == [] == seen((date(2023, 1, 1), date(2024, 1, 1)))
    assert history.identity(one) != H.History([one], COLUMNS, "d").identity(one)


def test_an_upload_without_rows(spark, tmp_path):
    none = upload(spark, tmp_path, 1, [], "2024-01")
    one = upload(spark, tmp_path, 2, [("a", FEB, 1.0)], "2024-02")
    assert values(spark, [none], "replace_period") == [] and values(spark, [none, one], "merge_dedupe") == [1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        values(spark, [H.Upload("gone", 1, str(tmp_path / "gone"))], "append")
