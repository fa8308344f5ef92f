import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import customers, decision, finance, inventory, kpi, rollup, sales, timeseries

SCHEMA = "order_key long, line_number int, transaction_date date, customer_name string, product_name string, branch_name string, quantity double, selling_price double, discount double, revenue decimal(18,4), cost_price decimal(18,4)"


def lines(spark, n=400, seed=1):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40))
    name = lambda p: None if rng.random() < 0.03 else f"{p}{rng.randrange(6)}"
    from decimal import Decimal

    rows = [(i // 2, i % 2, day(), name("c"), name("p"), name("b"), float(rng.randrange(1, 5)), 2.0, 0.0, Decimal(rng.randrange(-50, 900)), None if rng.random() < 0.2 else Decimal(rng.randrange(1, 9))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(known, df, stock):
    assert rows(known.kpi()) == rows(sales.sales_kpi(df)) and rows(known.finance()) == rows(finance.finance_summary(df)) and rows(known.rfm()) == rows(customers.rfm(df))
    for g in ("daily", "weekly", "monthly"):
        assert rows(known.trend(g)) == rows(sales.sales_trend(df, g))
    for kind, column in rollup.LABELS.items():
        assert rows(known.shares(kind)) == rows(sales.shares(df, column))
    assert rows(known.series()) == rows(timeseries.daily(df)) and rows(known.inventory(stock)) == rows(inventory.inventory_health(stock, df))


def test_reports_are_those_of_the_rows(spark):
    df = lines(spark)
    stock = df.filter("product_name is not null").groupBy("product_name").agg(F.max("transaction_date").alias("snapshot_date"), F.sum("quantity").alias("stock_qty"))
    check(rollup.Rollup.of(df), df, stock)
    empty = rollup.Rollup.of(df.limit(0))
    assert rows(empty.kpi()) == rows(sales.sales_kpi(df.limit(0))) and rows(empty.finance()) == rows(finance.finance_summary(df.limit(0))) and empty.series().count() == 0


def test_deltas_keep_a_store_up_to_date(spark, tmp_path):
    df = lines(spark)
    stock = df.groupBy("product_name").agg(F.max("transaction_date").alias("snapshot_date"), F.sum("quantity").alias("stock_qty"))
    store = rollup.RollupStore(spark, str(tmp_path))
    for k in range(3):
        store.add(df.filter(F.col("order_key") % 3 == k))
    gone = df.filter("order_key % 5 = 1 or customer_name = 'c3'")
    store.take_back(gone)
    left = df.exceptAll(gone)
    check(store.rollup(left), left, stock)
    store.compact()
    check(store.rollup(left), left, stock)
    check(store.rollup(df, version=3), df, stock)


def test_the_rows_are_scanned_once_and_one_day_again(spark, tmp_path):
    lines(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    facts = decision.evidence_of(rollup.Rollup.of(df), detectors="deviation")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    scans = [x for x in plan.splitlines() if "Relation [" in x]
    assert len(scans) <= 1 and (not scans or "transaction_date#" in plan.split("Relation [")[0].splitlines()[-2] + plan.split("Relation [")[0].splitlines()[-1])
    assert facts.first()["n_rows"] == 400 and decision.evidence(df).first()["n_points"] == facts.first()["n_points"]
    assert kpi.kpi_values(df).count() == 11
