"""Dashboards: named sets of widgets, each a DataFrame over one filtered frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import customers, finance, inventory, kpi, sales

WIDGETS: dict[str, Callable[..., DataFrame]] = {
    "kpi": lambda f: sales.sales_kpi(f["sales"]),
    "trend": lambda f: sales.sales_trend(f["sales"], f.get("granularity", "daily")),
    "branches": lambda f: sales.branch_kpi(f["sales"]),
    "abc": lambda f: sales.abc_analysis(f["sales"]),
    "rfm": lambda f: customers.rfm(f["sales"]),
    "cohort": lambda f: customers.cohort_retention(f["sales"]),
    "finance": lambda f: finance.finance_summary(f["sales"], f.get("purchases"), f.get("expenses")),
    "inventory": lambda f: inventory.inventory_health(f["stock"], f["sales"]),
    "pareto": lambda f: sales.pareto(f["sales"]),
    "profitability": lambda f: sales.profitability(f["sales"]),
    "kpi_status": lambda f: kpi.evaluate(f["sales"].sparkSession, kpi.kpi_values(f["sales"], f.get("purchases"), f.get("expenses"))),
}

DASHBOARDS = {
    "executive": ("kpi", "trend", "kpi_status", "finance"),
    "sales": ("kpi", "trend", "branches", "abc"),
    "products": ("abc", "pareto", "profitability"),
    "customers": ("rfm", "cohort"),
    "branches": ("branches", "trend"),
    "finance": ("finance", "profitability", "kpi_status"),
    "inventory": ("inventory", "abc"),
    "operations": ("kpi_status", "inventory", "trend"),
}


def resolve(name: str, frames: dict, **filters) -> dict[str, DataFrame]:
    """Widgets of a dashboard over the filtered frames. ``frames`` has sales and, as widgets need them, stock, purchases, expenses; widgets whose frame is missing are left out. Nothing runs until a widget is read."""
    if name not in DASHBOARDS:
        raise ValueError(f"unknown dashboard {name!r}")
    granularity = filters.pop("granularity", "daily")
    f = {**frames, "sales": sales.apply_filters(frames["sales"], **filters), "granularity": granularity}
    return {w: WIDGETS[w](f) for w in DASHBOARDS[name] if w != "inventory" or "stock" in f}


def executive_summary(sales: DataFrame, expenses: DataFrame | None = None, period: str = "all") -> DataFrame:
    """(section, position, line): a narrative, highlights, risks and advice, made of KPI and finance values only; no sales give zeros."""
    v = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0)).alias(name)
    row = kpi.kpi_values(sales, None, expenses).agg(*[v(n) for n in kpi.VALUES])
    say = lambda text, *names: F.format_string(text, *[F.col(n) for n in names])
    told = [
        ("narrative", say(f"Period {period}: revenue %.2f from %.0f orders, %.2f units, %.2f an order; growth %.2f %%, margin %.2f %%, net profit %.2f.", "revenue", "orders", "units", "aov", "growth_pct", "margin_pct", "net_profit")),
        ("highlight", say("Revenue %.2f from %.0f orders.", "revenue", "orders")),
        ("highlight", say("Mean order %.2f, %.2f units sold.", "aov", "units")),
        ("risk", say("Growth stands at %.2f %%.", "growth_pct")),
        ("risk", say("Margin stands at %.2f %%.", "margin_pct")),
        ("advice", F.when(F.col("growth_pct") < 0, "Look into the weaker half of the period.").otherwise("Keep up what made the period grow.")),
        ("advice", F.when(F.col("net_profit") < 0, "Bring costs below revenue.").otherwise("Watch the largest costs.")),
    ]
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("position"), t.alias("line")) for i, (s, t) in enumerate(told, 1)])
    return row.select(F.inline(lines))
