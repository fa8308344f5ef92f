"""Event-time alerting on small streams: civil days of a zone, late rows, days without rows, restarts."""

import datetime as dt

import pytest

from tidemark.streaming import daily

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "rule string, ts timestamp, value double, rid int"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(daily.PROVIDER)
    spark.conf.set(daily.PROVIDER, ROCKS)
    yield spark
    spark.conf.set(daily.PROVIDER, old)


def at(day, hour=12, minute=0):
    return dt.datetime(2025, 3, day, hour, minute)


class Run:
    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options

    def __call__(self, rows):
        """Adds rows as a file, runs the stream to its end and returns all that it has told."""
        self.spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = daily.alert_days(self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in"), **self.options)
        stream.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/cp").trigger(availableNow=True).start().awaitTermination(240)
        got = self.spark.read.schema(daily.OUTPUT).parquet(f"{self.path}/out").collect()
        return sorted((r["rule"], r["day"].day, r["n"], r["value"], r["action"]) for r in got)


def test_days_late_rows_and_restart(rocks, tmp_path):
    run = Run(rocks, str(tmp_path), rules={"a": ("above", 10), "b": ("lt", 5)}, late="6 hours", trailing=0)
    got = run([("a", at(1), 6.0), ("a", at(1, 20), 6.0), ("a", at(2), 20.0), ("b", at(1), 9.0), ("other", at(30), 1.0), ("a", None, 99.0), (None, at(1), 99.0), ("b", at(4), 7.0)])
    # The watermark stands at 6 o'clock on the fourth; rows of rules that nobody named do not move it.
    first = [("a", 1, 2, 12.0, "open"), ("a", 2, 1, 20.0, "keep"), ("a", 3, 0, None, "resolve"), ("b", 1, 1, 9.0, "none")]
    assert got == first
    # Started again: a row of the first is too late, one of the fourth is not, and the fifth resolves what the fourth opened.
    got = run([("a", at(1), 500.0), ("a", at(4, 7), 11.0), ("b", at(4, 23), None), ("b", at(6), 2.0)])
    assert got == sorted([*first, ("a", 4, 1, 11.0, "open"), ("a", 5, 0, None, "resolve"), ("b", 4, 2, 7.0, "none")])
    got = run([("b", at(9), 50.0)])
    assert [g for g in got if g[1] > 5] == [("b", 6, 1, 2.0, "open"), ("b", 7, 0, None, "resolve")]
    assert [g for g in got if g[1] <= 5] == sorted([*first, ("a", 4, 1, 11.0, "open"), ("a", 5, 0, None, "resolve"), ("b", 4, 2, 7.0, "none")])


def test_trailing_days_of_a_zone(rocks, tmp_path):
    # In New York clocks go forward on 9 March 2025; 3:30 UTC on the tenth is 23:30 there on the ninth, a day of 23 hours.
    run = Run(rocks, str(tmp_path), rules={"a": (">=", 10)}, zone="America/New_York", late="2 hours", trailing=1)
    got = run([("a", at(8, 5), 4.0), ("a", at(8, 4, 59), 1.0), ("a", at(9, 5), 2.0), ("a", at(10, 3, 30), 4.0), ("a", at(10, 4), 3.0), ("a", at(20), 0.0)])
    assert got == [("a", 7, 1, 1.0, "none"), ("a", 8, 2, 5.0, "none"), ("a", 9, 3, 10.0, "open"), ("a", 10, 3, 9.0, "resolve"), ("a", 11, 1, 3.0, "none")]


def test_bad_rules_and_store(rocks):
    events = rocks.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        daily.alert_days(events, {"a": ("about", 1)})
    rocks.conf.set(daily.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        daily.alert_days(events, {"a": (">", 1)})
