"""Finance summary: revenue, cost of goods, expenses and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import pct

WIDE = "decimal(38,6)"


def floored(c: Column) -> Column:
    return F.greatest(c.cast(WIDE), F.lit(0).cast(WIDE))


def _one(df: DataFrame | None, value: Column, name: str) -> DataFrame | None:
    return None if df is None else df.agg(F.coalesce(F.sum(value), F.lit(0).cast(WIDE)).cast(WIDE).alias(name))


def line_cost(quantity: str, cost: str) -> Column:
    return floored(F.col(quantity).cast("decimal(12,2)") * F.coalesce(F.col(cost).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")))


#: Columns with the cost of a whole line, by priority: fixed values.
LINE_TOTALS = ("cogs", "cost_of_goods_sold", "total_cost", "line_total", "total")


#: Column names of each fact that mean the same, in order of priority: fixed values.
NAMES = {
    "sales": {
        "revenue": ("revenue", "omzet", "nilai", "total", "subtotal"),
        "quantity": ("quantity", "qty", "jumlah", "jml", "volume"),
        "selling_price": ("selling_price", "harga jual", "price"),
        "discount": ("discount", "diskon", "disc"),
        "cost_price": ("cost_price", "unit_cost", "cost", "harga beli", "harga pokok"),
        "transaction_date": ("transaction_date", "tanggal transaksi", "tgl", "date", "order date"),
    },
    "purchases": {
        "quantity": ("quantity", "qty", "jumlah", "jml", "volume"),
        "cost": ("cost_price", "unit_cost", "cost", "harga beli", "harga pokok"),
    },
    "expenses": {"amount": ("amount", "nominal", "biaya", "pengeluaran")},
}


def resolved(df: DataFrame, fact: str) -> DataFrame:
    """A frame of sales, purchases or expenses under the names that ``finance_summary`` reads: for each, the first of its names that a column has, blanks and case aside, whatever the order of columns.

    One column can serve two names (a total is revenue where nothing else is, and a line total). Measures become decimals and dates dates; what is none is
    null. Columns that serve no name stay, of equal labels the first. An unknown fact is a ValueError.
    """
    if fact not in NAMES:
        raise ValueError(f"unknown fact {fact!r}; known: {', '.join(NAMES)}")
    labels: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        labels.setdefault(c.strip().lower(), i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out, served = [], set(NAMES[fact])
    for target, names in NAMES[fact].items():
        if hit := next((n for n in names if n in labels), None):
            served.add(hit)
            text = f"cast(c{labels[hit]} as string)"
            out.append(F.expr(f"cast(try_to_timestamp({text}) as date)" if target.endswith("_date") else f"try_cast({text} as decimal(28,6))").alias(target))
    for label, i in labels.items():
        if label in LINE_TOTALS:
            out.append(F.expr(f"try_cast(cast(c{i} as string) as decimal(28,6))").alias(label))
        elif label not in served:
            out.append(F.col(f"c{i}").alias(df.columns[i].strip()))
    return plain.select(*out)


def net_revenue(columns: list[str]) -> Column:
    """Revenue of a row: as stated, else quantity x price - discount; not below 0."""
    n = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) if c in columns else F.lit(0).cast(t)
    derived = n("quantity", "decimal(12,2)") * n("selling_price", "decimal(12,2)") - n("discount", "decimal(18,4)")
    return floored(F.coalesce(F.col("revenue").cast(WIDE), floored(derived)) if "revenue" in columns else derived)


def line_costs(columns: list[str], cost: str, total_first: bool) -> Column:
    """Cost of a row, not below 0: quantity x unit cost or a stated line total, whichever comes first and is there; 0 with neither."""
    total = next((c for c in LINE_TOTALS if c in columns), None)
    by_unit = {"quantity", cost} <= set(columns)
    stated = floored(F.coalesce(F.col(total).cast(WIDE), F.lit(0).cast(WIDE))) if total else None
    if stated is not None and (total_first or not by_unit):
        return stated
    return line_cost("quantity", cost) if by_unit else F.lit(0).cast(WIDE)


def windowed_sum(fact: DataFrame, value: str, date: str, sales: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row ``total``: the sum of a fact's column over the days from ``start`` to ``end``, both included; without either bound, over the span of the sales frame; without dates there, over all rows."""
    if start is None and end is None and sales is not None:
        span = F.broadcast(sales.agg(F.min("transaction_date").alias("_lo"), F.max("transaction_date").alias("_hi")))
        fact = fact.crossJoin(span).filter(F.col("_lo").isNull() | F.col(date).between(F.col("_lo"), F.col("_hi")))
    if start is not None:
        fact = fact.filter(F.col(date) >= F.to_date(F.lit(start)))
    if end is not None:
        fact = fact.filter(F.col(date) <= F.to_date(F.lit(end)))
    return fact.agg(F.round(F.coalesce(F.sum(F.col(value).cast(WIDE)), F.lit(0).cast(WIDE)), 2).cast("double").alias("total"))


def finance_summary(sales: DataFrame, purchases: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
    """One row: total_revenue, total_cogs, total_expenses, gross_profit, net_profit, margin_pct (net on revenue).

    Revenue and costs are floored at 0 row by row, expenses keep their sign. A row without a stated
    revenue counts quantity x price - discount. Costs come from the sales rows, by unit or as line
    totals; purchases (line totals first) count only where these have none. The caller cuts the
    frames to one window, as ``windowed_sum`` does for a single fact.
    """
    cost = line_costs(sales.columns, "cost_price", total_first=False)
    row = sales.agg(F.coalesce(F.sum(net_revenue(sales.columns)), F.lit(0).cast(WIDE)).cast(WIDE).alias("rev"), F.coalesce(F.sum(cost), F.lit(0).cast(WIDE)).cast(WIDE).alias("own"))
    return summary_of(row, purchases, expenses)


def summary_of(row: DataFrame, purchases: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
    """``finance_summary`` from the sums of a sales frame: one row with ``rev`` (revenue) and ``own`` (cost of its rows)."""
    zero = F.lit(0).cast(WIDE)
    bought = _one(purchases, line_costs(purchases.columns, "cost", total_first=True), "bought") if purchases is not None else None
    row = row.crossJoin(bought) if bought is not None else row.withColumn("bought", zero)
    spent = _one(expenses, F.col("amount").cast(WIDE), "spent")
    row = row.crossJoin(spent) if spent is not None else row.withColumn("spent", zero)
    cogs = F.when(F.col("own") == 0, F.col("bought")).otherwise(F.col("own"))
    gross = F.col("rev") - cogs
    net = gross - F.col("spent")
    d = lambda c: F.round(c, 2).cast("double")
    return row.select(
        d(F.col("rev")).alias("total_revenue"), d(cogs).alias("total_cogs"), d(F.col("spent")).alias("total_expenses"), d(gross).alias("gross_profit"), d(net).alias("net_profit"), pct(net, F.col("rev")).alias("margin_pct")
    )
