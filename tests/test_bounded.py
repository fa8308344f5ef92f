"""What keeps shuffles, memory and repeated reads from growing faster than the input."""

import datetime as dt
import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from tidemark.functions import best
from tidemark.operators import alerts, inventory, ml, recommend, retrieval, text_index, vector_index
from tidemark.sources import star


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_other_days_go_before_the_joins(spark, sf):
    frame = alerts.trailing(star.sales(spark, sf))
    sales = star.sales(spark, sf)
    last = sales.agg(F.max("transaction_date")).first()[0]
    assert frame.count() == sales.filter(F.col("transaction_date") >= last - dt.timedelta(days=1)).count() > 0
    assert "Join Cross" not in plan(frame) and "max(" not in plan(frame)
    assert alerts.trailing(sales.limit(0)).count() == 0


def test_older_snapshots_go_before_they_are_grouped(spark, sf):
    stock = star.stock(spark, sf)
    got = inventory.latest_snapshot(stock)
    assert plan(got).count("Aggregate") == 1  # the newest dates are known
    newest = {r["product_name"]: r["d"] for r in stock.groupBy("product_name").agg(F.max("snapshot_date").alias("d")).collect()}
    want = sorted((r["product_name"], r["snapshot_date"], r["warehouse"], r["stock_qty"]) for r in stock.collect() if newest[r["product_name"]] == r["snapshot_date"])
    assert sorted((r["product_name"], r["snapshot_date"], r["warehouse"], r["stock_qty"]) for r in got.collect()) == want
    assert inventory.latest_snapshot(stock.limit(0)).count() == 0


def test_baskets_of_one_product_read_the_sales_once(spark, sf):
    got = plan(recommend.bought_with(star.sales(spark, sf), "Brand#23"))
    assert got.count("l_orderkey") and len([x for x in got.splitlines() if "Relation" in x and "l_orderkey" in x]) == 1, got


def test_cosines_of_many_queries_take_bounded_memory():
    rng = np.random.default_rng(5)
    queries, rows, names = rng.normal(size=(4096, 8)), rng.normal(size=(1024, 8)), np.arange(1024)
    found = best.Best(4096, 3)
    tracemalloc.start()
    for j in range(3):
        retrieval.offer_cosines(found, np.arange(4096), queries, rows + j, names + 1024 * j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all pairs at once: 34 MB a matrix, and several of them
    at, cosine, got = found.rows()
    whole = np.concatenate([rows, rows + 1, rows + 2])
    exact = np.round((queries @ whole.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(whole, axis=1)), 6) + 0.0
    for q in range(0, 4096, 97):
        order = np.lexsort((np.arange(len(whole)), -exact[q]))[:3]
        assert got[at == q].tolist() == order.tolist() and cosine[at == q].tolist() == exact[q][order].tolist()


def test_vector_search_joins_and_sorts_no_pairs(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = vector_index.VectorIndex.build(e, str(tmp_path / "v"), cells=4)
    asked = e.filter("vec_id % 10 = 0")
    got = index.search(asked, k=3, block=3)
    assert "Join" not in plan(got)
    rows = lambda f: sorted((r["query_id"], r["rank"], r["id"], r["cosine"]) for r in f.collect())
    assert rows(got) == rows(index.search(asked, k=3)) and got.count() == 3 * asked.count()


def test_training_reads_a_series_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    days = spark.range(60).selectExpr("date_add(date'2024-01-01', cast(id as int)) as ds", "cast(id % 7 as double) as y").repartition(2)
    assert ml.gbt_forecast(days.mapInPandas(counted, "ds date, y double")).count() == 14
    assert read.value == 60


def test_states_of_chunks_lie_in_many_parts(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.apply(spark.range(600).selectExpr("id as chunk_id", "concat_ws(' ', transform(sequence(0, 40), x -> concat('w', cast((id * 31 + x * x) % 997 as string)))) as content"))
    sizes = [r["count"] for r in index._rows("doc").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 300  # before, they lay beside each other in one part or two
