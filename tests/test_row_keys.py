"""Keys of loaded rows: repeats of earlier jobs, reruns, false positives, growth of the filter."""

from pyspark.sql import functions as F

from tidemark.sources.row_keys import BLOCK, PER_KEY, RowKeys
from tidemark.streaming import ingest

ROW = "a int, b string, h int"


def rows(spark, values):
    return spark.createDataFrame(values, ROW)


def load(keys, frame, job):
    got = [tuple(r) for r in keys.unseen(frame, job).collect()]
    keys.add(keys.unseen(frame, job), job)
    return sorted(got, key=str)


def test_rows_of_earlier_jobs_are_left_out(spark, tmp_path):
    keys = RowKeys(spark, str(tmp_path / "k"))
    first = [(1, "x", None), (1, "x", None), (1, None, None), (1, "", None)]
    assert load(keys, rows(spark, first), 1) == sorted(set(first), key=str)
    second = [(1, None, None), (2, "y", 5), (2, "y", 5)]
    assert load(keys, rows(spark, second), 2) == [(2, "y", 5)]
    assert load(keys, rows(spark, second), 2) == [(2, "y", 5)]  # run again: its own keys do not count
    assert load(keys, rows(spark, []), 3) == []
    assert RowKeys(spark, str(tmp_path / "k")).size() == 4  # another session reads the same keys
    assert load(keys, rows(spark, first + second), 4) == []


def test_false_positives_are_told_apart(spark, tmp_path):
    keys = RowKeys(spark, str(tmp_path / "k"), capacity=1)
    keys._blocks = lambda: 1  # one block for all keys: every bit is set
    old = spark.range(3000).select(F.col("id").cast("int").alias("a"), F.lit("o").alias("b"), F.lit(1).alias("h"))
    keys.filter.append(keys._bits(keys_of(keys, old), 1), {"blocks": 1})
    keys.keys.append(keys_of(keys, old).withColumn("first", F.conv(F.hex(F.substring("h", 1, 1)), 16, 10).cast("int")), {"job": 0, "n": 3000})
    new = old.withColumn("b", F.when(F.col("a") < 100, "o").otherwise("n"))
    assert keys.suspects(keys_of(keys, new)).count() == 3000
    assert keys.unseen(new, 1).count() == 2900


def keys_of(keys, frame):
    from tidemark.sources.clean import row_hash

    return frame.select(F.unhex(row_hash(frame)).alias("h"))


def test_the_filter_grows_and_stays_sharp(spark, tmp_path):
    keys = RowKeys(spark, str(tmp_path / "k"), capacity=64)
    frame = lambda start, n: spark.range(start, start + n).select(F.col("id").cast("int").alias("a"), F.lit("v").alias("b"), F.lit(None).cast("int").alias("h"))
    for job in range(3):
        keys.add(frame(job * 2000, 2000), job)
    assert keys.size() == 6000 and keys._blocks() * BLOCK // PER_KEY >= 6000
    assert keys.suspects(keys_of(keys, frame(0, 6000))).count() == 6000  # nothing known is missed
    assert keys.suspects(keys_of(keys, frame(100_000, 20_000))).count() < 200  # under 1 %


def test_a_stream_leaves_out_rows_of_earlier_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    run = lambda: ingest.load_checked(ingest.read_folder(spark, str(src), "k int, v string", files_per_batch=1), out, ["v"], keys=RowKeys(spark, f"{out}/keys")).awaitTermination(180)
    (src / "a.csv").write_text("k,v\n1,x\n2,y\n2,y\n")
    run()
    (src / "b.csv").write_text("k,v\n2,y\n3,z\n4,\n")
    run()
    assert sorted(r["k"] for r in spark.read.parquet(f"{out}/table").collect()) == [1, 2, 3]
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(f"{out}/metrics").collect())
    assert got == [(3, 1, 1, 0, 1), (3, 2, 1, 0, 0)]
