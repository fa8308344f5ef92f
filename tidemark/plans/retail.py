"""Sales, finance, customer, stock and KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import customers, finance, inventory, kpi, likeness, recommend, sales, scenarios
from tidemark.registry import register
from tidemark.sources import star
from tidemark.sources.star import EXPENSES_SQL, SALES_SQL, STOCK_SQL

S = f"WITH {SALES_SQL}"
_ORDER = "transaction_date NULLS LAST, order_key, line_number, revenue"
_GROWTH = f"""halves AS (
  SELECT sum(CASE WHEN i <= n // 2 THEN revenue ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN i > n // 2 THEN revenue ELSE 0 END)::DOUBLE AS b
  FROM (SELECT revenue, row_number() OVER (ORDER BY {_ORDER}) AS i, count(*) OVER () AS n FROM sales)),
growth AS (SELECT CASE WHEN a <> 0 THEN round((b - a) / a * 100, 2) ELSE 0 END AS growth_pct FROM halves)"""


@register(
    "sales_kpi",
    f"""{S}, {_GROWTH} SELECT round(sum(revenue), 2)::DOUBLE AS revenue, count(*) AS orders, round(sum(quantity), 2) AS units, round(sum(revenue)::DOUBLE / count(*), 2) AS aov,
    any_value(growth_pct) AS growth_pct, 0.0::DOUBLE AS margin_pct FROM sales, growth""",
)
def sales_kpi(spark, sf_dir):
    return sales.sales_kpi(star.sales(spark, sf_dir))


_PERIODS = {
    "daily": "transaction_date::VARCHAR",
    "weekly": "date_trunc('week', transaction_date)::DATE::VARCHAR || '/' || (date_trunc('week', transaction_date)::DATE + 6)::VARCHAR",
    "monthly": "strftime(transaction_date, '%Y-%m')",
}
for _name, _sql in _PERIODS.items():

    @register(f"sales_trend_{_name}", f"{S} SELECT {_sql} AS period, round(sum(revenue), 2)::DOUBLE AS revenue, count(*) AS orders, round(sum(quantity), 2) AS units FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1")
    def _trend(spark, sf_dir, granularity=_name):
        return sales.sales_trend(star.sales(spark, sf_dir), granularity)


@register(
    "sales_filtered_kpi",
    f"""{S}, chosen AS (SELECT * FROM sales WHERE transaction_date >= DATE '1996-01-01' AND transaction_date < DATE '1998-01-01' AND branch_name = 'FRANCE')
    SELECT coalesce(round(sum(revenue), 2)::DOUBLE, 0) AS revenue, count(*) AS orders, coalesce(round(sum(quantity), 2), 0) AS units FROM chosen""",
)
def sales_filtered_kpi(spark, sf_dir):
    d = sales.apply_filters(star.sales(spark, sf_dir), "1996-01-01", "1997-12-31", branch="FRANCE")
    return d.agg(F.coalesce(F.round(F.sum("revenue"), 2).cast("double"), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("orders"), F.coalesce(F.round(F.sum("quantity"), 2), F.lit(0.0)).alias("units"))


@register("growth_half_split", f"{S}, {_GROWTH} SELECT a AS first_half, b AS second_half, growth_pct FROM halves, growth")
def growth_half_split(spark, sf_dir):
    return sales.growth(star.sales(spark, sf_dir))


def _finance_sql(cost: bool) -> str:
    own = "sum(greatest(quantity::DECIMAL(12,2) * cost_price, 0))" if cost else "0::DECIMAL(38,6)"
    return f"""{S}, {EXPENSES_SQL}, r AS (SELECT sum(greatest(revenue, 0))::DECIMAL(38,6) AS rev, {own}::DECIMAL(38,6) AS own FROM sales),
    b AS (SELECT sum(greatest(l_quantity::DECIMAL(12,2) * p_retailprice::DECIMAL(18,4), 0))::DECIMAL(38,6) AS bought FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
    e AS (SELECT sum(amount)::DECIMAL(38,6) AS spent FROM expenses), x AS (SELECT rev, CASE WHEN own = 0 THEN bought ELSE own END AS cogs, spent FROM r, b, e)
    SELECT round(rev, 2)::DOUBLE AS total_revenue, round(cogs, 2)::DOUBLE AS total_cogs, round(spent, 2)::DOUBLE AS total_expenses, round(rev - cogs, 2)::DOUBLE AS gross_profit,
    round(rev - cogs - spent, 2)::DOUBLE AS net_profit, CASE WHEN rev <> 0 THEN round((rev - cogs - spent)::DOUBLE / rev::DOUBLE * 100, 2) ELSE 0 END AS margin_pct FROM x"""


@register("finance_summary", _finance_sql(True))
def finance_summary(spark, sf_dir):
    return finance.finance_summary(star.sales(spark, sf_dir), star.purchases(spark, sf_dir), star.expenses(spark, sf_dir))


@register("finance_purchase_cogs", _finance_sql(False))
def finance_purchase_cogs(spark, sf_dir):
    return finance.finance_summary(star.sales(spark, sf_dir).drop("cost_price"), star.purchases(spark, sf_dir), star.expenses(spark, sf_dir))


def _share_sql(column: str, label: str, more: str = "") -> str:
    return f"""{S} SELECT {more}{column} AS {label}, round(sum(revenue), 2)::DOUBLE AS revenue, count(*) AS orders, round(sum(quantity), 2) AS units,
    round(sum(revenue)::DOUBLE / sum(sum(revenue)) OVER ()::DOUBLE * 100, 2) AS share_pct FROM sales GROUP BY {column}"""


@register("branch_kpi", f"SELECT branch, revenue, orders, share_pct FROM ({_share_sql('branch_name', 'branch')})")
def branch_kpi(spark, sf_dir):
    return sales.branch_kpi(star.sales(spark, sf_dir))


for _dim, _col in sales.DIMENSIONS.items():

    @register(f"drilldown_{_dim}", f"SELECT * FROM ({_share_sql(_col, 'label', repr(_dim) + ' AS dimension, ')}) ORDER BY revenue DESC, label LIMIT 50")
    def _drill(spark, sf_dir, dimension=_dim):
        return sales.drilldown(star.sales(spark, sf_dir), dimension)


@register("employee_analytics", f"SELECT employee, revenue, orders, share_pct FROM ({_share_sql('segment', 'employee')})")
def employee_analytics(spark, sf_dir):
    return sales.employee_analytics(star.sales(spark, sf_dir).withColumnRenamed("segment", "salesperson"))


_ABC = f"""{S}, g AS (SELECT product_name AS product, sum(revenue) AS r FROM sales GROUP BY 1),
c AS (SELECT product, r, r::DOUBLE / sum(r) OVER ()::DOUBLE * 100 AS share, sum(r) OVER (ORDER BY r DESC, product ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(r) OVER ()::DOUBLE * 100 AS cum FROM g),
abc AS (SELECT product, round(r, 2)::DOUBLE AS revenue, round(share, 2) AS share_pct, round(cum, 2) AS cumulative_pct, CASE WHEN cum <= 80 THEN 'A' WHEN cum <= 95 THEN 'B' ELSE 'C' END AS grade FROM c)"""


@register("abc_analysis", f"{_ABC} SELECT * FROM abc")
def abc_analysis(spark, sf_dir):
    return sales.abc_analysis(star.sales(spark, sf_dir))


@register("top_products", f"{_ABC} SELECT * FROM abc ORDER BY revenue DESC, product LIMIT 10")
def top_products(spark, sf_dir):
    return sales.abc_analysis(star.sales(spark, sf_dir)).orderBy(F.desc("revenue"), "product").limit(10)


@register("pareto", f"{_ABC} SELECT product AS label, revenue, share_pct, cumulative_pct, grade = 'A' AS pareto FROM abc")
def pareto(spark, sf_dir):
    return sales.pareto(star.sales(spark, sf_dir))


for _by in ("product", "branch"):

    @register(
        f"profitability_{_by}",
        f"""{S}, g AS (SELECT {sales.DIMENSIONS[_by]} AS label, sum(revenue) AS r, sum(greatest(quantity::DECIMAL(12,2) * cost_price, 0)) AS c, count(*) AS orders FROM sales GROUP BY 1)
        SELECT label, round(r, 2)::DOUBLE AS revenue, round(c, 2)::DOUBLE AS cogs, round(r - c, 2)::DOUBLE AS gross_profit, CASE WHEN r <> 0 THEN round((r - c)::DOUBLE / r::DOUBLE * 100, 2) ELSE 0 END AS margin_pct, orders FROM g""",
    )
    def _profit(spark, sf_dir, by=_by):
        return sales.profitability(star.sales(spark, sf_dir), by)


def _quintile(value: str, reverse: bool) -> str:
    p = f"((rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0) / count(*) OVER ())"
    band = f"CASE WHEN {p} <= 0.2 THEN 1 WHEN {p} <= 0.4 THEN 2 WHEN {p} <= 0.6 THEN 3 WHEN {p} <= 0.8 THEN 4 ELSE 5 END"
    return f"CASE WHEN min({value}) OVER () = max({value}) OVER () THEN 5 ELSE {'6 - ' if reverse else ''}({band}) END"


_RFM = f"""{S}, g AS (SELECT customer_name AS customer, max(transaction_date) AS last, count(*) AS frequency, sum(revenue) AS m FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1),
d AS (SELECT *, greatest(datediff('day', last, max(last) OVER ()), 0)::INTEGER AS recency_days FROM g),
s AS (SELECT customer, recency_days, frequency, round(m, 2)::DOUBLE AS monetary, ({_quintile('recency_days', True)})::INTEGER AS r_score, ({_quintile('frequency', False)})::INTEGER AS f_score, ({_quintile('m', False)})::INTEGER AS m_score FROM d),
rfm AS (SELECT *, CASE WHEN r_score + f_score + m_score >= 13 THEN 'champions' WHEN r_score + f_score + m_score >= 11 THEN 'loyal' WHEN r_score <= 2 THEN 'at_risk' WHEN f_score <= 2 THEN 'new' ELSE 'potential' END AS segment FROM s)"""


@register("rfm", f"{_RFM} SELECT * FROM rfm")
def rfm(spark, sf_dir):
    return customers.rfm(star.sales(spark, sf_dir))


@register("clv", f"{_RFM} SELECT *, round(monetary::DECIMAL(20,2) * (10 + frequency) * 0.1, 2)::DOUBLE AS clv FROM rfm")
def clv(spark, sf_dir):
    return customers.clv(star.sales(spark, sf_dir))


@register("segment_distribution", f"{_RFM} SELECT segment, count(*) AS customers, round(sum(monetary::DECIMAL(20,2)), 2)::DOUBLE AS monetary FROM rfm GROUP BY 1")
def segment_distribution(spark, sf_dir):
    return customers.segment_distribution(star.sales(spark, sf_dir))


@register(
    "cohort_retention",
    f"""{S}, m AS (SELECT DISTINCT customer_name, date_trunc('month', transaction_date)::DATE AS month FROM sales WHERE transaction_date IS NOT NULL),
    f AS (SELECT *, min(month) OVER (PARTITION BY customer_name) AS first FROM m),
    g AS (SELECT first, datediff('month', first, month)::INTEGER AS period_offset, count(*) AS active_customers FROM f GROUP BY 1, 2)
    SELECT strftime(first, '%Y-%m') AS cohort, period_offset, active_customers, round(active_customers::DOUBLE / max(CASE WHEN period_offset = 0 THEN active_customers END) OVER (PARTITION BY first)::DOUBLE * 100, 2) AS retention_pct FROM g""",
)
def cohort_retention(spark, sf_dir):
    return customers.cohort_retention(star.sales(spark, sf_dir))


_FEATURES = f"""{S}, g AS (SELECT customer_name, count(*) AS n, sum(revenue) AS r, max(transaction_date) AS last, min(transaction_date) AS first FROM sales GROUP BY 1),
features AS (SELECT customer_name, n AS total_orders, round(r, 2)::DOUBLE AS total_spending, datediff('day', last, max(last) OVER ())::INTEGER AS recency, n AS frequency, round(r, 2)::DOUBLE AS monetary,
  round(r::DOUBLE / n, 4) AS aov, datediff('day', first, max(last) OVER ())::INTEGER AS tenure FROM g)"""


@register("customer_features", f"{_FEATURES} SELECT * FROM features")
def customer_features(spark, sf_dir):
    return customers.customer_features(star.sales(spark, sf_dir))


@register("churn_label", f"{_FEATURES} SELECT *, (recency > 90 AND frequency <= 2)::INTEGER AS churn FROM features")
def churn_label(spark, sf_dir):
    return customers.churn_label(customers.customer_features(star.sales(spark, sf_dir)))


_LATEST = f"""{S}, {STOCK_SQL}, newest AS (SELECT product_name, max(snapshot_date) AS newest FROM stock GROUP BY 1),
latest AS (SELECT s.* FROM stock s JOIN newest n ON s.product_name = n.product_name AND s.snapshot_date = n.newest)"""
_DEMAND = """span AS (SELECT max(transaction_date) AS hi, min(transaction_date) AS lo FROM sales),
demand AS (SELECT product_name, sum(quantity) / least(30, greatest(1, datediff('day', any_value(lo), any_value(hi)) + 1)) AS units_per_day FROM sales, span WHERE transaction_date > hi - INTERVAL 30 DAY GROUP BY 1)"""


@register("inventory_latest_snapshot", f"{_LATEST} SELECT snapshot_date, product_name, warehouse, stock_qty FROM latest")
def inventory_latest_snapshot(spark, sf_dir):
    return inventory.latest_snapshot(star.stock(spark, sf_dir)).select("snapshot_date", "product_name", "warehouse", "stock_qty")


@register("demand_rate", f"{S}, {_DEMAND} SELECT product_name, round(units_per_day, 6) AS units_per_day FROM demand")
def demand_rate(spark, sf_dir):
    return inventory.demand_rate(star.sales(spark, sf_dir)).withColumn("units_per_day", F.round("units_per_day", 6))


@register(
    "inventory_health",
    f"""{_LATEST}, {_DEMAND}, j AS (SELECT l.product_name AS product, sum(stock_qty) AS q, coalesce(any_value(units_per_day), 0) AS a FROM latest l LEFT JOIN demand d ON l.product_name = d.product_name GROUP BY 1),
    k AS (SELECT *, CASE WHEN q <= 0 THEN 0 WHEN a > 0 THEN q / a ELSE 999 END AS days FROM j)
    SELECT product, round(q, 2) AS stock_qty, round(a, 2) AS avg_daily_sales, round(days, 2) AS days_of_stock, round(CASE WHEN q > 0 THEN a * 30 / q ELSE 0 END, 2) AS turnover,
    CASE WHEN q <= 0 OR days <= 3 THEN 'critical' WHEN days <= 7 THEN 'high' WHEN days <= 21 THEN 'medium' ELSE 'low' END AS stockout_risk, round(a * 7, 2) AS reorder_point, a = 0 AND q > 0 AS dead_stock FROM k""",
)
def inventory_health(spark, sf_dir):
    return inventory.inventory_health(star.stock(spark, sf_dir), star.sales(spark, sf_dir))


_VALUES = f"""{S}, {EXPENSES_SQL}, {_GROWTH}, v AS (
  SELECT round(sum(revenue), 2)::DOUBLE AS revenue, count(*)::DOUBLE AS orders, round(sum(quantity), 2) AS units, round(sum(revenue)::DOUBLE / count(*), 2) AS aov, any_value(growth_pct) AS growth_pct,
    sum(revenue)::DECIMAL(38,6) AS rev, sum(greatest(quantity::DECIMAL(12,2) * cost_price, 0))::DECIMAL(38,6) AS cogs, (SELECT sum(amount)::DECIMAL(38,6) FROM expenses) AS spent FROM sales, growth),
w AS (SELECT revenue, orders, units, aov, growth_pct, round((rev - cogs - spent)::DOUBLE / rev::DOUBLE * 100, 2) AS margin_pct, round(rev, 2)::DOUBLE AS total_revenue, round(cogs, 2)::DOUBLE AS total_cogs,
  round(spent, 2)::DOUBLE AS total_expenses, round(rev - cogs, 2)::DOUBLE AS gross_profit, round(rev - cogs - spent, 2)::DOUBLE AS net_profit FROM v),
vals AS (UNPIVOT w ON {', '.join(kpi.VALUES)} INTO NAME name VALUE value)"""
_DEFS = ", ".join(f"('{d.name}', '{d.unit}', {d.target}::DOUBLE, {d.warn}::DOUBLE, {d.crit}::DOUBLE)" for d in kpi.BUILTIN)


@register("kpi_values_long", f"{_VALUES} SELECT name, value FROM vals")
def kpi_values_long(spark, sf_dir):
    return kpi.kpi_values(star.sales(spark, sf_dir), None, star.expenses(spark, sf_dir))


@register(
    "kpi_evaluate",
    f"""{_VALUES}, defs(name, unit, target, warn, crit) AS (VALUES {_DEFS}),
    s AS (SELECT v.name, value, target, coalesce(unit, '') AS unit, CASE WHEN value < crit THEN 'crit' WHEN value < warn THEN 'warn' ELSE 'ok' END AS status FROM vals v LEFT JOIN defs d ON v.name = d.name)
    SELECT *, status <> 'ok' AS breach FROM s""",
)
def kpi_evaluate(spark, sf_dir):
    return kpi.evaluate(spark, kpi_values_long(spark, sf_dir))


def _measure_sql(year: int) -> str:
    return f"""SELECT unnest(['revenue', 'orders', 'units', 'aov']) AS name, unnest([r, n, u, CASE WHEN n > 0 THEN round(r / n, 2) ELSE 0 END]) AS v
    FROM (SELECT round(sum(revenue), 2)::DOUBLE AS r, count(*)::DOUBLE AS n, round(sum(quantity), 2) AS u FROM sales WHERE year(transaction_date) = {year})"""


@register(
    "compare_periods",
    f"""{S}, c AS ({_measure_sql(1998)}), p AS ({_measure_sql(1997)})
    SELECT c.name, round(c.v, 2) AS current, round(p.v, 2) AS previous, round(c.v - p.v, 2) AS delta, round(CASE WHEN p.v <> 0 THEN (c.v - p.v) / abs(p.v) * 100 WHEN c.v = 0 THEN 0 ELSE 100 END, 2) AS delta_pct FROM c JOIN p ON c.name = p.name""",
)
def compare_periods(spark, sf_dir):
    year = F.year("transaction_date")
    return kpi.compare_periods(star.sales(spark, sf_dir), year == 1998, year == 1997)


@register("popularity", f"{S} SELECT product_name, count(*) AS n FROM sales GROUP BY 1")
def popularity(spark, sf_dir):
    return recommend.popularity(star.sales(spark, sf_dir))


_PAIRS = f"{S}, b AS (SELECT DISTINCT customer_name, product_name FROM sales), pairs AS (SELECT x.product_name AS a, y.product_name AS b, count(*) AS customers FROM b x JOIN b y ON x.customer_name = y.customer_name AND x.product_name < y.product_name GROUP BY 1, 2)"


@register("cooccurrence_pairs", f"{_PAIRS} SELECT * FROM pairs")
def cooccurrence_pairs(spark, sf_dir):
    return recommend.cooccurrence(star.sales(spark, sf_dir))


_TFIDF = """prods AS (SELECT product_name AS product, min(category) AS category FROM sales GROUP BY 1), terms AS (SELECT product, unnest(list_filter(regexp_extract_all(lower(concat(product, ' ', category)), '[a-z0-9]+'), lambda w: length(w) > 1)) AS term FROM prods),
tf AS (SELECT product, term, count(*) AS tf FROM terms GROUP BY 1, 2), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM prods)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), w0 AS (SELECT product, tf.term, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
w AS (SELECT product, term, w / sqrt(sum(w * w) OVER (PARTITION BY product)) AS weight FROM w0)"""


@register(
    "recommend_product",
    f"""{_PAIRS}, {_TFIDF}, s AS (SELECT CASE WHEN a = 'Brand#23' THEN b ELSE a END AS product, customers * 2.0::DOUBLE AS s FROM pairs WHERE a = 'Brand#23' OR b = 'Brand#23'
      UNION ALL SELECT x.product, sum(x.weight * q.weight) * 1.5::DOUBLE FROM w x JOIN w q ON x.term = q.term WHERE q.product = 'Brand#23' AND x.product <> 'Brand#23' GROUP BY 1)
    SELECT product, round(sum(s), 3) AS score FROM s GROUP BY 1 ORDER BY score DESC, product LIMIT 10""",
)
def recommend_product(spark, sf_dir):
    return recommend.recommend(star.sales(spark, sf_dir), product="Brand#23", k=10)


@register(
    "recommend_customer",
    f"""{_PAIRS}, own AS (SELECT product_name AS product FROM b WHERE customer_name = 'Customer#000000001'), both_ways AS (SELECT a AS x, b AS product, customers FROM pairs UNION ALL SELECT b, a, customers FROM pairs),
    s AS (SELECT product, sum(customers)::DOUBLE AS s FROM both_ways WHERE x IN (SELECT product FROM own) AND product NOT IN (SELECT product FROM own) GROUP BY 1),
    final AS (SELECT * FROM s UNION ALL SELECT product_name, count(*) * 0.1::DOUBLE FROM sales WHERE NOT EXISTS (SELECT 1 FROM s) GROUP BY 1)
    SELECT product, round(s, 3) AS score FROM final ORDER BY score DESC, product LIMIT 10""",
)
def recommend_customer(spark, sf_dir):
    return recommend.recommend(star.sales(spark, sf_dir), customer="Customer#000000001", k=10)


_ELASTIC = """e0 AS (SELECT count(*) AS n, regr_slope(quantity, selling_price) AS slope, avg(quantity) AS mq, avg(selling_price) AS mp, stddev_samp(quantity) AS sq, stddev_samp(selling_price) AS sp FROM sales),
e AS (SELECT *, CASE WHEN n < 8 THEN 'too few rows' WHEN mq <= 0 OR mp <= 0 THEN 'mean price or quantity is not positive' WHEN sq = 0 OR sp = 0 OR slope IS NULL THEN 'no variance in price or quantity' WHEN slope >= 0 THEN 'slope is not negative' ELSE '' END AS reason FROM e0),
el AS (SELECT n, round(slope, 6) AS slope, CASE WHEN reason = '' THEN round(slope * mp / mq, 4) END AS elasticity, reason = '' AS supported, reason FROM e),
t AS (SELECT sum(revenue)::DOUBLE AS revenue, sum(quantity)::DOUBLE AS units, count(*) AS cnt, count(DISTINCT customer_name) AS customers FROM sales)"""


@register("elasticity", f"{S}, {_ELASTIC} SELECT * FROM el")
def elasticity(spark, sf_dir):
    return scenarios.elasticity(star.sales(spark, sf_dir))


@register(
    "scenario_price",
    f"""{S}, {_ELASTIC} SELECT 'price_change_pct' AS type, supported, elasticity, round(elasticity * 5, 2) AS units_pct, round(((1 + 5.0::DOUBLE / 100) * (1 + elasticity * 5 / 100) - 1) * 100, 2) AS revenue_pct,
    round(revenue * (((1 + 5.0::DOUBLE / 100) * (1 + elasticity * 5 / 100) - 1) * 100) / 100, 2) AS revenue_delta, round(revenue, 2) AS baseline_revenue, round(least(0.8, 0.3 + cnt / 50), 3)::DOUBLE AS confidence, reason FROM t, el""",
)
def scenario_price(spark, sf_dir):
    return scenarios.price_change(star.sales(spark, sf_dir), 5.0)


@register(
    "scenario_inventory",
    f"""{S}, {_ELASTIC}, d AS (SELECT coalesce(stddev_samp(r), 0) AS s FROM (SELECT sum(revenue)::DOUBLE AS r FROM sales GROUP BY transaction_date))
    SELECT 'inventory_change_pct' AS type, revenue > 0 AND units > 0 AND cnt >= 5 AS supported, round(units * 10.0::DOUBLE / 100 * revenue / units, 2) AS revenue_delta, round(units * 10.0::DOUBLE / 100, 2) AS units_delta,
    round(units * 10.0::DOUBLE / 100 * revenue / units - 1.28::DOUBLE * s, 2) AS revenue_lower, round(units * 10.0::DOUBLE / 100 * revenue / units + 1.28::DOUBLE * s, 2) AS revenue_upper, round(least(0.7, 0.3 + cnt / 50), 3)::DOUBLE AS confidence FROM t, d""",
)
def scenario_inventory(spark, sf_dir):
    return scenarios.inventory_change(star.sales(spark, sf_dir), 10.0)


@register(
    "scenario_churn",
    f"""{S}, {_ELASTIC}, d AS (SELECT coalesce(stddev_samp(r), 0) AS s FROM (SELECT sum(revenue)::DOUBLE AS r FROM sales GROUP BY customer_name))
    SELECT 'churn_rise_pp' AS type, customers >= 5 AND revenue > 0 AS supported, round(revenue * (-2.0::DOUBLE / 100), 2) AS revenue_delta, customers, round(revenue * (-2.0::DOUBLE / 100) - 1.28::DOUBLE * s * 0.02::DOUBLE * sqrt(customers), 2) AS revenue_lower,
    round(revenue * (-2.0::DOUBLE / 100) + 1.28::DOUBLE * s * 0.02::DOUBLE * sqrt(customers), 2) AS revenue_upper, round(least(0.7, 0.3 + customers / 40), 3)::DOUBLE AS confidence FROM t, d""",
)
def scenario_churn(spark, sf_dir):
    return scenarios.churn_rise(star.sales(spark, sf_dir), 2.0)


@register(
    "product_neighbours",
    """WITH prods AS (SELECT p_partkey AS product, regexp_extract_all(lower(concat_ws(' ', p_name, p_type, p_brand)), '[a-z0-9]+') AS words FROM part), terms AS (SELECT product, unnest(list_filter(words, lambda x: length(x) > 1)) AS term FROM prods),
    tf AS (SELECT product, term, count(*) AS tf FROM terms GROUP BY 1, 2), idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT product) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), w0 AS (SELECT product, tf.term, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
    w AS (SELECT product, term, w / sqrt(sum(w * w) OVER (PARTITION BY product)) AS w FROM w0),
    c AS (SELECT a.product AS product, b.product AS neighbour, round(sum(a.w * b.w), 9) AS cosine FROM w a JOIN w b ON a.term = b.term AND a.product <> b.product GROUP BY 1, 2)
    SELECT product, row_number() OVER (PARTITION BY product ORDER BY cosine DESC, neighbour) AS rank, neighbour, cosine FROM c QUALIFY rank <= 5""",
)
def product_neighbours(spark, sf_dir):
    """The five nearest products of every product by the TF-IDF cosine of name, type and brand."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return likeness.nearest(star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), text.alias("text")), "product", "text")
