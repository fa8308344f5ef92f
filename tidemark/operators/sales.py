"""Sales KPIs, trends, shares and classes.

Frames have the columns of ``tidemark.sources.star.sales``. Measures are summed before any window,
so windows run over groups (days, products, branches), never over fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.money import pct, total

#: Column names that mean the same, in order of priority: fixed values.
ALIASES = {
    "transaction_date": ("transaction_date", "tanggal transaksi", "tgl", "date", "order date"),
    "customer_name": ("customer_name", "nama customer", "pelanggan", "customer", "customer name", "nm customer"),
    "product_name": ("product_name", "nm brg", "nama barang", "nama produk", "barang", "product name"),
    "branch_name": ("branch_name", "nm cabang", "nama cabang", "cabang", "branch"),
    "quantity": ("quantity", "qty", "jumlah", "jml"),
    "selling_price": ("selling_price", "harga jual", "price"),
    "discount": ("discount", "diskon", "disc"),
    "revenue": ("revenue", "total", "omzet"),
}


def canonicalize(df: DataFrame) -> DataFrame:
    """Columns renamed to canonical names by alias priority; the first claimant of a name wins and later ones are dropped. Revenue is quantity x price - discount where no column states it; blanks count 0."""
    by_name = {}
    for c in df.columns:
        by_name.setdefault(c.strip().lower(), c)
    chosen, used = {}, set()
    for target, names in ALIASES.items():
        if hit := next((by_name[n] for n in names if n in by_name), None):
            chosen[target] = F.col(f"`{hit}`")
        used |= {by_name[n] for n in names if n in by_name}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    out = df.select(*[c.alias(n) for n, c in chosen.items()], *rest)
    number = lambda n: F.coalesce(F.expr(f"try_cast(`{n}` as double)"), F.lit(0.0))
    for n in ("quantity", "selling_price", "discount"):
        if n in chosen:
            out = out.withColumn(n, number(n))
    if "revenue" in chosen:
        out = out.withColumn("revenue", F.coalesce(F.expr("try_cast(revenue as decimal(18,4))"), F.lit(0).cast("decimal(18,4)")))
    elif {"quantity", "selling_price"} <= set(chosen):
        gross = F.col("quantity") * F.col("selling_price") - (F.col("discount") if "discount" in chosen else F.lit(0.0))
        out = out.withColumn("revenue", gross.cast("decimal(18,4)"))
    if "transaction_date" in chosen:
        out = out.withColumn("transaction_date", F.expr("cast(try_to_timestamp(cast(transaction_date as string)) as date)"))
    return out


def apply_filters(df: DataFrame, date_from: str | None = None, date_to: str | None = None, branch: str | None = None, category: str | None = None) -> DataFrame:
    """Rows from ``date_from`` to the end of ``date_to``; a bound that is no date, or a column that is absent, skips its condition."""
    import datetime as dt

    def day(s):
        try:
            return dt.date.fromisoformat(str(s)[:10])
        except ValueError:
            return None

    for bound, test in ((day(date_from), lambda c, d: c >= F.lit(d)), (day(date_to), lambda c, d: c < F.lit(d + dt.timedelta(days=1)))):
        if bound and "transaction_date" in df.columns:
            df = df.filter(test(F.col("transaction_date"), bound))
    for name, value in (("branch_name", branch), ("category", category)):
        if value and name in df.columns:
            df = df.filter(F.col(name) == value)
    return df


def day_sums(df: DataFrame) -> DataFrame:
    """(transaction_date, n, r, q): rows, revenue and quantity of each day."""
    q = F.sum("quantity") if "quantity" in df.columns else F.lit(None).cast("double")
    return df.groupBy("transaction_date").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"), q.alias("q"))


def half_split(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row: revenue of the first floor(n/2) rows by date (nulls last; ties by order, line, revenue) and of the rest.

    ``days`` are the frame's ``day_sums``, which are made where they are not given. Only the day on which the half falls
    is read again and ranked row by row, in ranges; every other day is summed whole.
    """
    w = Window.orderBy(F.col("transaction_date").asc_nulls_last())  # a row a day
    days = ranks.saved(day_sums(df)) if days is None else days
    days = days.select("transaction_date", "n", "r", (F.sum("n").over(w) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) / 2).alias("half"))
    whole = days.agg(F.sum(F.when(F.col("before") + F.col("n") <= F.col("half"), F.col("r"))).alias("whole"), F.sum("r").alias("all"))
    zero = F.lit(0).cast("decimal(28,4)")
    cut = days.filter((F.col("before") < F.col("half")) & (F.col("before") + F.col("n") > F.col("half"))).select("transaction_date", (F.col("half") - F.col("before")).alias("take")).first()
    if cut is None:
        part = whole.select(zero.alias("part")).limit(1)
    else:
        day = F.col("transaction_date").isNull() if cut["transaction_date"] is None else F.col("transaction_date") == F.lit(cut["transaction_date"])
        part = ranks.running(df.filter(day).select("order_key", "line_number", "revenue"), ["order_key", "line_number", "revenue"], rank="i")
        part = part.agg(F.sum(F.when(F.col("i") <= cut["take"], F.col("revenue"))).alias("part"))
    first = F.coalesce("whole", zero) + F.coalesce("part", zero)
    return whole.crossJoin(part).select(first.cast("double").alias("first_half"), (F.coalesce("all", zero) - first).cast("double").alias("second_half"))


def growth(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row: growth_pct of the second half's revenue on the first's; 0 if the first half has none."""
    return half_split(df, days).select("first_half", "second_half", pct(F.col("second_half") - F.col("first_half"), F.col("first_half")).alias("growth_pct"))


def sales_kpi(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row: revenue, orders (rows), units, aov, growth_pct, margin_pct (0: the frame has no costs here), from the frame's ``day_sums``."""
    days = ranks.saved(day_sums(df)) if days is None else days
    n = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    aov = F.when(n > 0, F.round(F.sum("r").cast("double") / n, 2)).otherwise(F.lit(0.0))
    base = days.agg(total(F.col("r")).alias("revenue"), n.alias("orders"), F.coalesce(F.round(F.sum("q"), 2), F.lit(0.0)).alias("units"), aov.alias("aov"))
    return base.crossJoin(growth(df, days).select("growth_pct")).withColumn("margin_pct", F.lit(0.0))


def period(granularity: str) -> Column:
    d = F.col("transaction_date")
    if granularity == "monthly":
        return F.date_format(d, "yyyy-MM")
    if granularity == "weekly":
        monday = F.date_trunc("week", d).cast("date")
        return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))
    return d.cast("string")


def sales_trend(df: DataFrame, granularity: str = "daily") -> DataFrame:
    """period, revenue, orders, units, in order of period; undated rows are left out; an unknown granularity is daily."""
    return (
        df.filter(F.col("transaction_date").isNotNull())
        .groupBy(period(granularity).alias("period"))
        .agg(total(F.col("revenue")).alias("revenue"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("quantity"), 2).alias("units"))
        .orderBy("period")
    )


def shares(df: DataFrame, dimension: str) -> DataFrame:
    """label, revenue, orders, units, share_pct of the whole frame's revenue, by any column."""
    g = df.groupBy(F.col(dimension).cast("string").alias("label")).agg(F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("quantity"), 2).alias("units"))
    g = ranks.saved(g)  # read for the total and for the shares
    g = g.crossJoin(ranks.one_row(g, F.sum("r").alias("whole")))
    return g.select("label", F.round("r", 2).cast("double").alias("revenue"), "orders", "units", pct(F.col("r"), F.col("whole")).alias("share_pct"))


def branch_kpi(df: DataFrame) -> DataFrame:
    return shares(df, "branch_name").select(F.col("label").alias("branch"), "revenue", "orders", "share_pct").orderBy(F.desc("revenue"), "branch")


DIMENSIONS = {"branch": "branch_name", "product": "product_name", "customer": "customer_name"}


def drilldown(df: DataFrame, dimension: str, limit: int = 50) -> DataFrame:
    """The ``limit`` (1 to 500) largest groups; shares are of the whole frame."""
    if dimension not in DIMENSIONS:
        raise ValueError("dimension must be one of: branch, product, customer")
    out = shares(df, DIMENSIONS[dimension]).select(F.lit(dimension).alias("dimension"), "*")
    return out.orderBy(F.desc("revenue"), "label").limit(max(1, min(500, limit)))


def abc_analysis(df: DataFrame, key: str = "product_name") -> DataFrame:
    """product, revenue, share_pct, cumulative_pct, grade: A up to 80 % of cumulated revenue, B up to 95 %, else C, the product itself included."""
    g = df.groupBy(F.col(key).alias("product")).agg(F.sum("revenue").alias("r"))
    g = ranks.saved(g)
    g = ranks.running(g, [F.desc("r"), F.col("product")], sums={"run": "r"}).crossJoin(ranks.one_row(g, F.sum("r").alias("whole")))
    whole = F.col("whole")
    cum = F.when(whole != 0, F.col("run").cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))
    return g.select(
        "product", F.round("r", 2).cast("double").alias("revenue"), pct(F.col("r"), whole).alias("share_pct"), F.round(cum, 2).alias("cumulative_pct"),
        F.when(cum <= 80, "A").when(cum <= 95, "B").otherwise("C").alias("grade"),
    )


def pareto(df: DataFrame, key: str = "product_name") -> DataFrame:
    """label, revenue, share_pct, cumulative_pct and whether the label is within the first 80 %."""
    a = abc_analysis(df, key)
    return a.select(F.col("product").alias("label"), "revenue", "share_pct", "cumulative_pct", (F.col("grade") == "A").alias("pareto"))


def profitability(df: DataFrame, by: str = "product") -> DataFrame:
    """label, revenue, cogs, gross_profit, margin_pct, orders. Without a unit cost column there is no answer: ValueError."""
    if by not in ("product", "branch"):
        raise ValueError("by must be one of: product, branch")
    if not {"cost_price", "quantity"} <= set(df.columns):
        raise ValueError("unsupported: no unit cost in the frame (needs quantity and cost_price)")
    cogs = F.greatest(F.col("quantity").cast("decimal(12,2)") * F.coalesce("cost_price", F.lit(0).cast("decimal(18,4)")), F.lit(0).cast("decimal(30,6)"))
    g = df.groupBy(F.col(DIMENSIONS[by]).cast("string").alias("label")).agg(F.sum("revenue").alias("r"), F.sum(cogs).alias("c"), F.count(F.lit(1)).alias("orders"))
    gross = F.col("r") - F.col("c")
    return g.select(
        "label", F.round("r", 2).cast("double").alias("revenue"), F.round("c", 2).cast("double").alias("cogs"), F.round(gross, 2).cast("double").alias("gross_profit"), pct(gross, F.col("r")).alias("margin_pct"), "orders"
    )


def employee_analytics(df: DataFrame, column: str | None = None) -> DataFrame:
    """employee, revenue, orders, share_pct; ValueError where no employee column exists."""
    name = column or next((c for c in df.columns if c.lower() in ("employee", "employee_name", "sales_person", "salesperson", "karyawan", "kasir", "cashier")), None)
    if name is None:
        raise ValueError("unsupported: no employee column in the frame")
    return shares(df, name).select(F.col("label").alias("employee"), "revenue", "orders", "share_pct")


def enrich(df: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """df with ``columns`` of products looked up by product name, white space collapsed and case folded; unknown names give nulls. Where products share a name, the least values count, so rows are never repeated."""
    folded = F.lower(F.trim(F.regexp_replace("product_name", r"\s+", " ")))
    known = products.groupBy(folded.alias("_name")).agg(F.min(F.struct(*columns)).alias("_known"))
    kept = [c for c in df.columns if c not in columns]
    return df.withColumn("_name", folded).join(known, "_name", "left").select(*kept, *[F.col("_known")[c].alias(c) for c in columns])
