import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versions import Change, Conflict, Table


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_versions_snapshots_and_compaction(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "v long")
    assert t.version() == 0 and t.read().count() == 0
    assert [t.append(rows(spark, i)) for i in (1, 2, 3)] == [1, 2, 3]
    assert values(t.read()) == [1, 2, 3] and values(t.read(2)) == [1, 2]
    assert t.compact() == 4 and len(t.parts()) == 1
    assert {r["v"]: r["_version"] for r in t.read().collect()} == {1: 1, 2: 2, 3: 3}  # rows keep the version that brought them
    assert values(t.read(1)) == [1]
    with pytest.raises(ValueError):
        t.read(9)


def test_expiry_keeps_what_is_named(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "v long")
    for i in range(6):
        t.append(rows(spark, i))
    t.compact()
    unfinished = t.stage(rows(spark, 99))
    assert t.expire(keep=2) == 0  # the version before the compaction still names all parts
    assert values(t.read(6)) == list(range(6))
    with pytest.raises(ValueError):
        t.read(3)
    t.append(rows(spark, 7))
    assert t.expire(keep=1) == 6  # the six parts that the compaction replaced
    assert values(t.read()) == [0, 1, 2, 3, 4, 5, 7] and t.version() == 8
    assert t.expire(keep=1, grace_s=0) == 1 and not (tmp_path / "t" / "parts" / unfinished).exists()
    assert t.append(rows(spark, 8)) == 9 and values(t.read()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    """Appends, and changes that read the whole table and replace it by one row: every one of them counts exactly once."""
    t = Table(spark, str(tmp_path / "t"), "v long")
    t.append(rows(spark, 0))
    errors, planned = [], []

    def add_one(version):
        planned.append(version)
        total = t.read(version).agg(F.sum("v")).first()[0]
        return Change((t.stage(rows(spark, total + 1), partitions=1),), tuple(t.parts(version)))

    def work(k):
        try:
            mine = Table(spark, str(tmp_path / "t"), "v long")
            for _ in range(3):
                mine.commit(add_one) if k % 2 else mine.append(rows(spark, 100), partitions=1)
        except Exception as e:  # noqa: BLE001  reported below
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors
    assert t.read().agg(F.sum("v")).first()[0] == 6 + 6 * 100 and t.version() == 13
    assert len(planned) > 6  # some plans were made again


def test_a_lost_compaction_is_a_conflict(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "v long")
    t.append(rows(spark, 1))
    old = tuple(t.parts())
    t.compact()
    part = t.stage(rows(spark, 5))
    with pytest.raises(Conflict):
        t.commit(lambda _: Change((part,), old, blind=True))
    assert values(t.read()) == [1] and not (tmp_path / "t" / "parts" / part).exists()


def test_kpi_store(spark, tmp_path):
    from tidemark.operators import kpi

    store = kpi.Store(spark, str(tmp_path))
    assert store.registry()["revenue"].crit == 5000000.0
    store.define(kpi.Definition("revenue", "EUR", 10.0, 5.0, 2.0), kpi.Definition("waste", "kg", 1.0, 2.0, 3.0, up=False))
    told = lambda *v: spark.createDataFrame([("revenue", float(v[0])), ("waste", float(v[1]))], "name string, value double")
    assert {r["name"]: r["status"] for r in store.snapshot(told(4, 5), "2024-01-01").collect()} == {"revenue": "warn", "waste": "crit"}
    store.remove("revenue")
    store.snapshot(told(6, 1), "2024-02-01")
    got = [(str(r["taken_at"])[:7], r["name"], r["status"]) for r in store.history().collect()]
    assert got == [("2024-02", "revenue", "crit"), ("2024-02", "waste", "ok"), ("2024-01", "revenue", "warn"), ("2024-01", "waste", "crit")]
    assert {r["name"]: r["change"] for r in store.trend().collect()} == {"revenue": 2.0, "waste": -4.0}
    assert store.history(1).count() == 1 and store.history(name="waste").count() == 2


def test_alert_ledger(spark, tmp_path):
    from tidemark.operators import alerts

    ledger = alerts.Ledger(spark, str(tmp_path))
    told = lambda **fires: spark.createDataFrame([(r, f, 1.0 * i, "high") for i, (r, f) in enumerate(fires.items())], "rule string, fires boolean, value double, severity string")
    ledger.observe(told(a=True, b=True, c=False), "2024-01-01")
    ids = {r["rule"]: r["alert_id"] for r in ledger.alerts().collect()}
    assert set(ids) == {"a", "b"} and ledger.acknowledge([ids["a"], 7], "2024-01-02", "me") == [ids["a"]]
    assert ledger.acknowledge([ids["a"]], "2024-01-02", "you") == []
    ledger.observe(told(a=True, b=False, c=True), "2024-01-03")
    ledger.observe(told(a=False, b=True, c=True), "2024-01-04")
    got = sorted((r["rule"], r["status"], r["observations"], r["acknowledged_by"]) for r in ledger.alerts().collect())
    assert [(r, s, n) for r, s, n, _ in got] == [("a", "resolved", 2), ("b", "open", 1), ("b", "resolved", 1), ("c", "open", 2)] and got[0][3] == "me"
    assert [r["rule"] for r in ledger.listing("open").collect()] == ["b", "c"]
    both = [threading.Thread(target=alerts.Ledger(spark, str(tmp_path)).observe, args=(told(d=True), "2024-01-05")) for _ in range(2)]
    [x.start() for x in both]
    [x.join() for x in both]
    assert [(r["status"], r["observations"]) for r in ledger.listing(rule="d").collect()] == [("open", 2)]
    for bad in (("", "sales.aov", ">", 1), ("r", "sales.none", ">", 1), ("r", "sales.aov", "~", 1), ("r", "sales.aov", ">", "x"), ("r", "sales.aov", ">", float("inf"))):
        with pytest.raises(ValueError):
            alerts.check_rule(*bad)
    alerts.check_rule("r", "sales.aov", "above", "3")


def test_registry_writers_at_once(spark, tmp_path):
    from tidemark.operators import models

    work = [threading.Thread(target=models.Registry(spark, str(tmp_path)).create, args=("m", f"/p{k}")) for k in range(3)]
    [x.start() for x in work]
    [x.join() for x in work]
    r = models.Registry(spark, str(tmp_path))
    assert sorted(x["version"] for x in models.states(r.log()).collect()) == ["v1", "v2", "v3"]
    assert r.log().select("event_id").distinct().count() == 6
