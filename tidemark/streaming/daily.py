"""Alerting by event time: civil days of a named time zone, rules over trailing days, and timers that close days nobody wrote to.

Rows are first counted by rule and day (partial aggregation before the shuffle, so a rule with very many rows is
no task's load); a day goes on once the watermark has passed its end. A processor keyed by rule then holds one entry for each
of the last few days and whether an alert is open. A timer at the end of every day evaluates the rule, so an alert also
resolves on a day without rows, as soon as rows of any rule move the watermark past it.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.alerts import normalize_condition

DAY = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "rule string, day date, n long, value double, fires boolean, action string"
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def civil_days(events: DataFrame, zone: str, late: str) -> DataFrame:
    """(rule, day as a window of local time, n, total) of rows (rule, ts, value) by civil day of ``zone``, each once the watermark has passed its end; rows later than that are not counted.

    Local times stand as if they were UTC, so days of 23 or 25 hours are whole. Where clocks go back an hour is
    told twice, so ``late`` should be an hour at least. Null times and rules are left out; a null value counts as a row.
    """
    local = F.from_utc_timestamp("ts", zone)
    rows = events.filter("ts is not null and rule is not null").select("rule", local.alias("local"), F.col("value").cast("decimal(28,6)").alias("value"))
    days = rows.withWatermark("local", late).groupBy("rule", F.window("local", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("decimal(38,6)").alias("total"))
    return days.select("rule", "w", "n", "total")


class Rules(StatefulProcessor):
    """State of a rule: rows and total of the trailing days that have rows, and whether its alert is open. Gone when it is closed and no day is left."""

    def __init__(self, rules: dict[str, tuple[str, float]], trailing: int):
        self.rules, self.trailing = rules, trailing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "n long, total decimal(38,6)")
        self.alert = handle.getValueState("alert", "is_open boolean, next_day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for day, n, total in zip(frame["day"], frame["n"], frame["total"], strict=True):
                self.days.updateValue((int(day),), (int(n), None if pd.isna(total) else total))
                first = int(day) if first is None else min(first, int(day))
        if first is not None and not self.alert.exists():
            self._await(False, first)
        yield pd.DataFrame()

    def _await(self, is_open: bool, day: int) -> None:
        self.alert.update((is_open, day))
        self.handle.registerTimer((day + 1) * DAY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes every day up to the watermark: one may have jumped over several."""
        if not self.alert.exists():
            return
        condition, threshold = self.rules[key[0]]
        is_open, day = self.alert.get()
        held = {k[0]: tuple(v) for k, v in self.days.iterator()}  # a trailing day each, or what came in this batch
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while (day + 1) * DAY <= now and (is_open or held):
            if not is_open and min(held) > day:
                day = min(held)  # nothing happens on the days between
                continue
            mine = [held[d] for d in range(day - self.trailing, day + 1) if d in held]
            known = [total for _, total in mine if total is not None]
            value = float(sum(known)) if known else None  # decimals, so days add up exactly
            fires = value is not None and COMPARE[condition](value, threshold)
            action = "keep" if fires and is_open else "open" if fires else "resolve" if is_open else "none"
            out.append((key[0], dt.date(1970, 1, 1) + dt.timedelta(days=day), sum(n for n, _ in mine), value, bool(fires), action))
            is_open = bool(fires)
            day += 1
            for d in [d for d in held if d < day - self.trailing]:
                del held[d]
                self.days.removeKey((d,))
        if is_open or held:
            self._await(is_open, day)
        else:
            self.alert.clear()
        yield pd.DataFrame(out, columns=["rule", "day", "n", "value", "fires", "action"])

    def close(self) -> None:
        pass


def alert_days(events: DataFrame, rules: dict[str, tuple[str, float]], zone: str = "UTC", late: str = "1 day", trailing: int = 1) -> DataFrame:
    """Stream (rule, day, n, value, fires, action) of a stream (rule, ts, value): for every civil day, the sum of the day's and the ``trailing`` days' values before it, whether it meets the rule's condition and threshold, and open, keep, resolve or none.

    ``rules``: {rule: (condition, threshold)}; rows of other rules are left out. A day without rows in all its trailing days never fires, and is told
    only if it resolves an alert. A restart from the checkpoint goes on with open alerts and timers.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), and append mode.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER):
        raise ValueError(f"state with timers needs the RocksDB provider in {PROVIDER}")
    known = {name: (normalize_condition(c), float(t)) for name, (c, t) in rules.items()}
    days = civil_days(events.filter(F.col("rule").isin(*known)), zone, late)
    day = F.floor(F.unix_millis(F.col("w.start")) / DAY).cast("int")
    rows = days.select("rule", F.window_time("w").alias("at"), day.alias("day"), "n", "total")
    return rows.groupBy("rule").transformWithStateInPandas(Rules(known, trailing), OUTPUT, "append", "EventTime")
