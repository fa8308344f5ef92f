"""Finance over frames with other column names."""

import datetime as dt

import pytest

from tidemark.operators import finance


def test_summary_of_frames_under_other_names(spark):
    sales = spark.createDataFrame([("2025-01-01", "2", "10", "1", "3", 99.0), ("no date", "x", None, None, None, None)], "Tgl string, ` QTY ` string, `Harga Jual` string, disc string, `harga beli` string, other double")
    bought = spark.createDataFrame([(5, 7.0)], "jumlah int, unit_cost double")
    spent = spark.createDataFrame([("4.5",), (None,), ("-1",)], "Biaya string")
    s = finance.resolved(sales, "sales")
    assert s.columns == ["quantity", "selling_price", "discount", "cost_price", "transaction_date", "other"]
    assert [r["transaction_date"] for r in s.orderBy("other").collect()] == [None, dt.date(2025, 1, 1)]
    row = finance.finance_summary(s, finance.resolved(bought, "purchases"), finance.resolved(spent, "expenses")).first()
    assert (row["total_revenue"], row["total_cogs"], row["total_expenses"], row["net_profit"]) == (19.0, 6.0, 3.5, 9.5)


def test_priority_not_the_order_of_columns(spark):
    both = spark.createDataFrame([("1", "2", "3")], "Total string, nilai string, revenue string")
    assert [float(x) for x in finance.resolved(both, "sales").select("revenue", "total").first()] == [3.0, 1.0]
    one = finance.resolved(both.drop("nilai", "revenue"), "sales")
    assert [float(x) for x in one.select("revenue", "total").first()] == [1.0, 1.0]
    twice = both.toDF("qty", "qty", "qty")
    assert float(finance.resolved(twice, "purchases").first()["quantity"]) == 1.0
    assert finance.resolved(both.limit(0), "sales").count() == 0
    with pytest.raises(ValueError):
        finance.resolved(both, "stock")
