"""Alerting over a stream: windowed metrics with a watermark, and keyed open/resolve state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, every: str = "1 day", late: str = "1 day", key: str = "event_type") -> DataFrame:
    """(key, window start, n, total) over tumbling windows of ts; rows later than the watermark are not counted."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col(key).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("rule", F.col("w.start").alias("at"), "n", "total")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("at")
    is_open = bool(state.get[0]) if state.exists else False
    out = []
    for at, fires in zip(rows["at"], rows["fires"], strict=True):
        action = "keep" if fires and is_open else "open" if fires else "resolve" if is_open else "none"
        is_open = bool(fires)
        out.append((key[0], at, bool(fires), action))
    state.update((is_open,))
    yield pd.DataFrame(out, columns=["rule", "at", "fires", "action"])


def transitions(observations: DataFrame) -> DataFrame:
    """The stream form of the batch transitions: (rule, at, fires) to (rule, at, fires, action), one state a rule."""
    return observations.groupBy("rule").applyInPandasWithState(_step, "rule string, at timestamp, fires boolean, action string", "open boolean", "append", GroupStateTimeout.NoTimeout)
