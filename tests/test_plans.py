import datetime as dt

import pytest

from tidemark.plans import dashboards
from tidemark.sources import files, schedule, star, validate

NOON = dt.datetime(2025, 3, 5, 12, 0)  # a Wednesday


@pytest.mark.parametrize("expression, last, due", [
    ("0 12 * * *", NOON - dt.timedelta(hours=1), True), ("0 12 * * *", NOON, False), ("*/15 * * * *", NOON - dt.timedelta(minutes=5), True), ("0 13 * * *", NOON - dt.timedelta(hours=1), False),
    ("0 9 * * mon-fri", NOON - dt.timedelta(days=1), True), ("0 9 * * sun", NOON - dt.timedelta(days=2), False), ("0 0 1 jan *", NOON - dt.timedelta(days=400), False), ("0 12 5 * 0", NOON - dt.timedelta(minutes=1), True), ("0 12 * * *", None, True),
])
def test_schedule(expression, last, due):
    assert schedule.is_due(expression, last, NOON) is due


def test_bad_schedules():
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            schedule.parse(bad)


def test_validation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    (tmp_path / "b.parquet").write_text("no parquet")
    (tmp_path / "c.csv").write_text("")
    ok = validate.validate(spark, str(tmp_path / "a.csv"))
    assert ok["errors"] == [] and ok["delimiter"] == ";" and len(ok["sha256"]) == 64
    assert validate.validate(spark, str(tmp_path / "b.parquet"))["errors"]
    assert validate.validate(spark, str(tmp_path / "c.csv"))["errors"] == ["empty or no such file"]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", True, 2.5), (2, None, False, None)], "n int, t string, b boolean, x double")
    (tmp_path / "o.xlsx").write_bytes(files.xlsx_bytes(df))
    back = files.read_xlsx(spark, str(tmp_path / "o.xlsx"))
    assert back.columns == df.columns
    assert [tuple(r) for r in back.collect()] == [("1", "a & b", "true", "2.5"), ("2", None, "false", None)]
    with pytest.raises(ValueError):
        files.xlsx_bytes(spark.range(20), most_rows=10)


@pytest.mark.parametrize("name", dashboards.DASHBOARDS)
def test_dashboards(spark, sf, name):
    frames = {"sales": star.sales(spark, sf), "stock": star.stock(spark, sf), "expenses": star.expenses(spark, sf)}
    got = dashboards.resolve(name, frames, date_from="1996-01-01", granularity="monthly")
    assert set(got) == set(dashboards.DASHBOARDS[name])
    assert all(df.limit(1).count() == 1 for df in got.values())


def test_acknowledging_only_open_alerts(spark):
    from tidemark.operators import alerts

    df = spark.createDataFrame([(1, "open"), (2, "resolved"), (3, "open")], "alert_id int, status string")
    got = {r["alert_id"]: (r["status"], r["acknowledged_by"]) for r in alerts.acknowledge(df, [1, 2], "2025-01-01", "me").collect()}
    assert got == {1: ("acknowledged", "me"), 2: ("resolved", None), 3: ("open", None)}
