"""Certified metrics and the words that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric and aliases: fixed values.
METRICS = {
    "revenue": ("revenue", "pendapatan", "omzet", "omset", "penjualan"),
    "orders": ("orders", "pesanan", "order", "transaksi", "transactions"),
    "units": ("units", "unit", "kuantitas", "quantity", "qty", "jumlah barang"),
    "aov": ("aov", "nilai pesanan rata-rata", "rata-rata order", "average order"),
    "growth_pct": ("growth", "pertumbuhan", "growth_pct", "kenaikan"),
    "margin_pct": ("margin", "margin_pct", "marjin"),
    "total_revenue": ("total_revenue", "total pendapatan"),
    "total_cogs": ("total_cogs", "hpp", "beban pokok", "cogs", "cost of goods"),
    "total_expenses": ("total_expenses", "beban", "expenses", "biaya operasional", "pengeluaran"),
    "gross_profit": ("gross_profit", "laba kotor", "gross"),
    "net_profit": ("net_profit", "laba bersih", "net", "profit"),
}


def mentions(text: Column, aliases: tuple[str, ...]) -> Column:
    """Whether one of the aliases stands in the text as whole words, in any case."""
    words = "|".join(a.replace(".", r"\.") for a in aliases)
    return F.lower(text).rlike(rf"(?<!\w)(?:{words})(?!\w)")


def match(questions: DataFrame, column: str = "text", most: int = 4) -> DataFrame:
    """questions with ``metrics``: the first ``most`` names, in alphabetical order, of the metrics that the text mentions."""
    hits = F.array_compact(F.array(*[F.when(mentions(F.col(column), METRICS[m]), F.lit(m)) for m in sorted(METRICS)]))
    return questions.withColumn("metrics", F.slice(hits, 1, most))


#: Words of a question and the tool that answers it, in the order in which tools run.
INTENTS = {
    "get_kpi": ("kpi", "ringkas", "summary", "pendapatan", "revenue", "omzet"),
    "query_sales": ("tren", "trend", "penjualan", "sales", "grafik"),
    "query_inventory": ("stok", "stock", "inventory", "gudang"),
    "query_customer": ("customer", "pelanggan", "rfm", "churn"),
    "query_product": ("produk", "product", "abc", "kategori"),
    "query_finance": ("keuangan", "finance", "margin", "laba", "profit"),
    "get_forecast": ("forecast", "prediksi", "ramal", "proyeksi"),
    "get_anomaly": ("anomali", "anomaly", "janggal", "outlier"),
    "get_customer_segment": ("segmen", "segment", "cluster"),
    "generate_report": ("laporan", "report", "eksekutif", "mingguan", "bulanan"),
    "query_sql": ("sql", "select "),
}
DEFAULT_TOOLS = ("get_kpi", "query_sales")


def route(questions: DataFrame, column: str = "text", most: int = 8) -> DataFrame:
    """questions with ``tools``, array of at most ``most`` tool names; a question that names none gets the defaults."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    named = [F.when(low.rlike("|".join(words)), F.lit(tool)) for tool, words in INTENTS.items()]
    tools = F.slice(F.array_compact(F.array(*named)), 1, most)
    return questions.withColumn("tools", F.when(F.size(tools) > 0, tools).otherwise(F.array(*[F.lit(t) for t in DEFAULT_TOOLS])))
