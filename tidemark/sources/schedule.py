"""Cron schedules of imports: whether one is due."""

from __future__ import annotations

import datetime as dt

#: Names of months and days of the week: fixed values.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: How far back a missed tick still counts.
MOST_DAYS = 32


def _values(field: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    number = lambda s: names[s.lower()] if s.lower() in names else int(s)
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"bad step in {part!r}")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = (number(x) for x in span.split("-", 1))
        else:
            a = number(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(f"{part!r} is not within {low} to {high}")
        out |= set(range(a, b + 1, every))
    return out


def parse(expression: str) -> list[set[int]]:
    """Minutes, hours, days, months and weekdays (Sunday 0 or 7) of a five-field expression."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    names = ({}, {}, {}, MONTHS, DAYS)
    out = [_values(f, lo, hi, n) for f, (lo, hi), n in zip(fields, RANGES, names, strict=True)]
    out[4] = {d % 7 for d in out[4]}
    return out


def is_due(expression: str, last_run: dt.datetime | None, now: dt.datetime) -> bool:
    """Whether a tick lies after the last run and not after now. Without a last run, only the present minute counts."""
    minutes, hours, days, months, weekdays = parse(expression)
    fields = expression.split()
    now = now.replace(second=0, microsecond=0)
    start = max(last_run, now - dt.timedelta(days=MOST_DAYS)) if last_run else now - dt.timedelta(minutes=1)
    day = now.date()
    while day >= start.date():
        in_month, in_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        # If both day fields are given, either will do.
        fits = (in_month or in_week) if fields[2] != "*" and fields[4] != "*" else in_month and in_week
        if fits and day.month in months:
            for h in sorted(hours, reverse=True):
                for m in sorted(minutes, reverse=True):
                    tick = dt.datetime.combine(day, dt.time(h, m), now.tzinfo)
                    if start < tick <= now:
                        return True
        day -= dt.timedelta(days=1)
    return False
