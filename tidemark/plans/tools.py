"""Read-only tools that answer questions: each reads frames and yields evidence, says that there is none, or fails with a reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import anomaly, customers, finance, inventory, ml, sales, timeseries

from . import dashboards, guard

Frames = dict[str, DataFrame]


@dataclass
class Answer:
    """What a tool found. ``outcome``: data, no_data or error; there is no fourth, so a missing figure is never a 0."""

    tool: str
    source: str
    outcome: str
    data: DataFrame | None = None
    reason: str | None = None


def _forecast(f: Frames, a: dict) -> DataFrame:
    return timeseries.forecast(timeseries.daily(f["sales"]), int(a.get("horizon", 30)))


#: Name of a tool: (source it names, frames it needs, the work).
TOOLS: dict[str, tuple[str, tuple[str, ...], Callable[[Frames, dict], DataFrame]]] = {
    "get_kpi": ("fact_sales", ("sales",), lambda f, a: sales.sales_kpi(f["sales"])),
    "query_sales": ("fact_sales", ("sales",), lambda f, a: sales.sales_trend(f["sales"], str(a.get("granularity") or "daily"))),
    "query_inventory": ("fact_inventory", ("stock", "sales"), lambda f, a: inventory.inventory_health(f["stock"], f["sales"])),
    "query_customer": ("fact_sales:rfm", ("sales",), lambda f, a: customers.rfm(f["sales"])),
    "query_product": ("fact_sales:abc", ("sales",), lambda f, a: sales.abc_analysis(f["sales"])),
    "query_finance": ("finance", ("sales",), lambda f, a: finance.finance_summary(f["sales"])),
    "get_forecast": ("ml.forecast", ("sales",), _forecast),
    "get_anomaly": ("ml.anomaly", ("sales",), lambda f, a: anomaly.detect(timeseries.daily(f["sales"]), float(a.get("sensitivity", 2.5)))),
    "get_customer_segment": ("ml.segment", ("sales",), lambda f, a: ml.segments(customers.customer_features(f["sales"]))[0]),
    "generate_report": ("reporting", ("sales",), lambda f, a: dashboards.executive_summary(f["sales"])),
}


def execute(spark: SparkSession, name: str, frames: Frames, args: dict | None = None, tables: set[str] | None = None) -> Answer:
    """Runs one tool over the frames; ``query_sql`` runs a guarded statement (args["sql"]) over the allowed ``tables``. A frame that is missing or cannot be read, and a statement that is refused, is an error; a first frame without rows is no_data."""
    args = args or {}
    if name == "query_sql":
        try:
            return Answer(name, "sql", "data", guard.run(spark, str(args.get("sql") or ""), tables or set()))
        except (PermissionError, PySparkException) as e:
            return Answer(name, "sql", "error", reason=str(e).splitlines()[0][:300])
    if name not in TOOLS:
        return Answer(name, name, "error", reason=f"unknown_tool: {name[:64]}")
    source, needs, work = TOOLS[name]
    try:
        missing = [n for n in needs if n not in frames]
        if missing:
            return Answer(name, source, "error", reason=f"missing frame: {', '.join(missing)}")
        if frames[needs[0]].isEmpty():
            return Answer(name, source, "no_data")
        return Answer(name, source, "data", work(frames, args))
    except (ValueError, PySparkException) as e:
        return Answer(name, source, "error", reason=str(e).splitlines()[0][:300])


def _finite(value, dtype: T.DataType):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
    if isinstance(dtype, T.DecimalType):
        return value.cast("double")
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, dtype.elementType))
    return value


def evidence(answer: DataFrame) -> DataFrame:
    """(evidence): each row as a JSON object; numbers that are no numbers or infinite become null, decimals plain numbers, dates text; nulls are written out."""
    columns = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in answer.schema.fields]
    return answer.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("evidence"))
