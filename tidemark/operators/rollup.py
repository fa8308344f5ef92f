"""One small table of daily sums from which KPIs, trends, branches, finance, forecasts and RFM segments follow.

The fact rows are read once: grouping sets add them up by (day, branch), (day, product) and (day, customer).
All measures are sums, so rollups of batches add up, and rows that go are a batch with the opposite
sign. Only growth needs rows again, those of the one day on which half of all rows falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.money import pct, total
from tidemark.sources.versions import Change, Table

from . import customers, finance, inventory, sales

CELLS = "kind string, transaction_date date, label string, n long, revenue decimal(38,4), quantity double, net decimal(38,6), cost decimal(38,6)"
LABELS = {"branch": "branch_name", "product": "product_name", "customer": "customer_name"}


def cells(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, transaction_date, label, n, revenue, quantity, net, cost): sums by day and branch, product or customer, from one scan. ``sign`` -1 takes rows back. Columns that a frame lacks count as null; undated rows have a null day."""
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    names = list(LABELS.values())
    one = rows.select(
        has("transaction_date", "date").alias("transaction_date"), *[has(c, "string").cast("string").alias(c) for c in names], F.coalesce(has("revenue", "decimal(18,4)"), F.lit(0)).cast("decimal(18,4)").alias("revenue"),
        F.coalesce(has("quantity", "double").cast("double"), F.lit(0.0)).alias("quantity"), finance.net_revenue(rows.columns).alias("net"), finance.line_costs(rows.columns, "cost_price", total_first=False).alias("cost"),
    )
    kind = F.when(F.grouping("branch_name") == 0, "branch").when(F.grouping("product_name") == 0, "product").otherwise("customer")
    sums = one.groupingSets([["transaction_date", c] for c in names], "transaction_date", *names).agg(
        kind.alias("kind"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("revenue", "quantity", "net", "cost")]
    )
    kinds = {"n": "long", "revenue": "decimal(38,4)", "quantity": "double", "net": "decimal(38,6)", "cost": "decimal(38,6)"}
    return sums.select("kind", "transaction_date", F.coalesce(*names).alias("label"), *[(F.col(c) * sign).cast(t).alias(c) for c, t in kinds.items()])


def added(parts: DataFrame) -> DataFrame:
    """Cells of several batches as one; days of which nothing is left go."""
    return parts.groupBy("kind", "transaction_date", "label").agg(*[F.sum(c).alias(c) for c in ("n", "revenue", "quantity", "net", "cost")]).filter("n <> 0")


class Rollup:
    """Reports over saved cells. ``rows`` are the fact rows, of which growth reads one day."""

    def __init__(self, known: DataFrame, rows: DataFrame):
        self.cells, self.rows = known, rows
        self._days = known.filter("kind = 'branch'").groupBy("transaction_date").agg(*[F.sum(c).alias(c) for c in ("n", "revenue", "quantity", "net", "cost")])

    @classmethod
    def of(cls, rows: DataFrame) -> Rollup:
        return cls(ranks.saved(cells(rows)), rows)

    def _of(self, kind: str) -> DataFrame:
        return self.cells.filter(F.col("kind") == kind)

    def days(self) -> DataFrame:
        """(transaction_date, n, r, q): rows, revenue and quantity of each day."""
        return self._days.select("transaction_date", "n", F.col("revenue").alias("r"), F.col("quantity").alias("q"))

    def kpi(self) -> DataFrame:
        """As ``sales.sales_kpi``."""
        return sales.sales_kpi(self.rows, self.days())

    def trend(self, granularity: str = "daily") -> DataFrame:
        """As ``sales.sales_trend``."""
        g = self._days.filter("transaction_date is not null").groupBy(sales.period(granularity).alias("period"))
        return g.agg(total(F.col("revenue")).alias("revenue"), F.sum("n").alias("orders"), F.round(F.sum("quantity"), 2).alias("units")).orderBy("period")

    def shares(self, kind: str = "branch") -> DataFrame:
        """As ``sales.shares`` of branches, products or customers."""
        g = self._of(kind).groupBy("label").agg(F.sum("revenue").alias("r"), F.sum("n").alias("orders"), F.round(F.sum("quantity"), 2).alias("units"))
        g = g.crossJoin(F.broadcast(self._days.agg(F.sum("revenue").alias("whole"))))
        return g.select("label", F.round("r", 2).cast("double").alias("revenue"), "orders", "units", pct(F.col("r"), F.col("whole")).alias("share_pct"))

    def finance(self, purchases: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
        """As ``finance.finance_summary``."""
        zero = F.lit(0).cast(finance.WIDE)
        row = self._days.agg(F.coalesce(F.sum("net"), zero).cast(finance.WIDE).alias("rev"), F.coalesce(F.sum("cost"), zero).cast(finance.WIDE).alias("own"))
        return finance.summary_of(row, purchases, expenses)

    def series(self) -> DataFrame:
        """As ``timeseries.daily``."""
        return self._days.filter("transaction_date is not null").select(F.col("transaction_date").alias("ds"), F.round("revenue", 2).cast("double").alias("y"))

    def rfm(self, ref_date: str | None = None) -> DataFrame:
        """As ``customers.rfm``."""
        g = self._of("customer").filter("transaction_date is not null").groupBy(F.col("label").alias("customer"))
        return customers.rfm_of(g.agg(F.max("transaction_date").alias("last"), F.sum("n").alias("frequency"), F.sum("revenue").alias("money")), ref_date)

    def inventory(self, stock: DataFrame) -> DataFrame:
        """As ``inventory.inventory_health``: what it reads of the sales are quantities by day and product."""
        return inventory.inventory_health(stock, self._of("product").select("transaction_date", F.col("label").alias("product_name"), "quantity"))


class RollupStore:
    """Cells of a growing fact table in a versioned table: every batch adds its own, rows that go are taken back by their batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Table(spark, folder, CELLS)

    def add(self, batch: DataFrame) -> int:
        return self.table.append(cells(batch))

    def take_back(self, batch: DataFrame) -> int:
        """Rows that were added and are gone; a changed row is taken back as it was and added as it is."""
        return self.table.append(cells(batch, -1))

    def compact(self) -> int:
        """One set of cells in place of those of all batches."""
        return self.table.commit(lambda v: Change((self.table.stage(added(self.table.read(v))),), tuple(self.table.parts(v))))

    def rollup(self, rows: DataFrame, version: int | None = None) -> Rollup:
        """Reports as of a version; ``rows`` are the fact rows of that state."""
        return Rollup(ranks.saved(added(self.table.read(version))), rows)
