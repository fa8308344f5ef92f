import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sales
from tidemark.sources import catalogue, clean, files, validate, warehouse


def test_csv_heads_are_read_without_the_whole_file(spark, tmp_path):
    """A sparse file of 3 GB: more than a binary reader can hold."""
    path = tmp_path / "big.csv"
    with open(path, "wb") as f:
        f.write(b"a;b\n1;2\n")
        f.truncate(3 << 30)
    assert files.head(spark, str(path), 8) == b"a;b\n1;2\n" and len(files.head(spark, str(path))) == 65536
    got = validate.validate(spark, str(path), most_bytes=2 << 30)
    assert got["size"] == 3 << 30 and got["errors"] == [f"over {2 << 30} bytes"] and len(got["sha256"]) == 64


def test_heads_of_folders_and_missing_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_SUCCESS").write_text("")
    (tmp_path / "d" / "part-0.csv").write_text("x,y\n1,2\n")
    assert files.head(spark, str(tmp_path / "d")) == files.head(spark, str(tmp_path / "d" / "*.csv")) == b"x,y\n1,2\n"
    assert files.head(spark, str(tmp_path / "none.csv")) == b""
    assert validate.validate(spark, str(tmp_path / "d" / "part-0.csv"))["sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()


@pytest.mark.parametrize("text, rows, bad", [
    ('{\n "a": 1,\n "b": "x"\n}\n', [(1, "x")], 0), ('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]', [(1, "x"), (2, None)], 0), ('{"a": 1, "b": "x"}\n{"a": 2}\nnot json\n', [(1, "x"), (2, None)], 1), ('  {"a": 5, "b": "y"}', [(5, "y")], 0), ("", [], 0),
])
def test_json_documents_and_lines(spark, tmp_path, text, rows, bad):
    (tmp_path / "f.json").write_text(text)
    good, lost = files.read_json(spark, str(tmp_path / "f.json"), "a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows, key=str) and lost.count() == bad


def test_zip_members_of_any_supported_type(spark, tmp_path):
    members = {"notes.md": "no", "dir/data.csv": 'a,b\n1,"two\x85three"\n', "later.json": "[]"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    assert [tuple(r) for r in files.read_any(spark, str(tmp_path / "a.zip"), work=str(tmp_path / "w1")).collect()] == [("1", "two\x85three")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.jsonl", json.dumps({"a": 7}))
    assert files.read_any(spark, str(tmp_path / "b.zip"), work=str(tmp_path / "w2"), schema="a int").first()["a"] == 7
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.exe", "no")
    with pytest.raises(ValueError):
        files.read_any(spark, str(tmp_path / "c.zip"), work=str(tmp_path / "w3"))


def test_csv_text_pages_and_full_reads(spark, tmp_path):
    df = files.from_csv_text(spark, '﻿a,b\r\n1,"x\ny"\r\n,\r\n2\r\n')
    assert [tuple(r) for r in df.collect()] == [("1", "x\ny"), ("2", None)] and df.columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.from_csv_text(spark, "\n")
    ids = spark.range(25)
    assert [r["id"] for r in files.page(ids, ["id"], 3, 10).collect()] == [20, 21, 22, 23, 24] and files.page(ids, ["id"], 4, 10).count() == 0
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3,4\n5,6\n")
    assert [tuple(r) for r in files.read_full(spark, str(tmp_path / "f.csv"), 2, ["b", "none"]).collect()] == [("2",), ("4",)]


def test_exports(spark, tmp_path):
    df = files.union_of([spark.createDataFrame([(1, True)], "a int, b boolean"), spark.createDataFrame([("é", 2)], "c string, a int")])
    assert files.export(df, "csv") == "a,b,c\r\n1,true,\r\n2,,é\r\n".encode("utf-8-sig")
    assert files.export(df, "xlsx")[:2] == b"PK"
    with pytest.raises(ValueError):
        files.export(df, "pdf")
    files.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv"))).split(b"\r\n")[0] == b"a,b,c"


def test_row_hashes_do_not_collide(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("-", "x"), ("", "1:x"), ("1:", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert clean.deduplicate(df).count() == len(rows) and df.select(clean.row_hash(df)).distinct().count() == len(rows)


def test_dimensions_get_or_create_and_upsert(spark):
    dim = spark.createDataFrame([(4, "A", "Ann", "x"), (9, "123", None, "y")], "id int, code string, name string, city string")
    wanted = spark.createDataFrame([("B",), ("A",), (" B ",), ("123.0",), (None,), ("nan",), ("",)], "code string")
    got = {r["code"]: (r["id"], r["name"]) for r in warehouse.get_or_create(dim, wanted, "code").collect()}
    assert got == {"A": (4, "Ann"), "123": (9, None), "B": (10, None)}
    rows = spark.createDataFrame([("123.0", "Bob"), ("C", "Cy"), ("A", None), ("C", "Ca")], "code string, name string")
    got = {r["code"]: (r["id"], r["name"], r["city"]) for r in warehouse.upsert(dim, rows, "code").collect()}
    assert got == {"A": (4, "Ann", "x"), "123": (9, "Bob", "y"), "C": (10, "Cy", None)}
    assert warehouse.get_or_create(dim.limit(0), wanted.limit(0), "code").count() == 0


def test_facts_are_loaded_once_with_ids(spark, tmp_path):
    dim = spark.createDataFrame([(1, "A")], "id int, branch string")
    facts = spark.createDataFrame([("A", 1.0), ("B", 2.0), (None, 3.0)], "branch string, revenue double")
    path = str(tmp_path / "facts")
    grown = warehouse.load(facts, {"branch": (dim, "branch_id")}, path, 7)["branch"]
    again = warehouse.load(facts, {"branch": (grown, "branch_id")}, path, 7)["branch"]
    warehouse.load(facts.limit(1), {"branch": (again, "branch_id")}, path, 8)
    assert sorted((r["id"], r["branch"]) for r in again.collect()) == [(1, "A"), (2, "B")]
    got = sorted((r["import_job_id"], r["branch_id"], r["revenue"]) for r in spark.read.parquet(path).fillna(-1, ["branch_id"]).collect())
    assert got == [(7, -1, 3.0), (7, 1, 1.0), (7, 2, 2.0), (8, 1, 1.0)]


def test_catalogue_lookup(spark):
    names = spark.createDataFrame([("  kopi   BUBUK 200g ",), ("unknown",), (None,)], "product_name string")
    got = [(r["unit"], r["image_url"]) for r in sales.enrich(names, catalogue.products(spark), ["unit", "image_url"]).orderBy(F.desc_nulls_last("unit")).collect()]
    assert got[0] == ("pak", "/images/demo-products/kopi-bubuk-200g.svg") and got[1:] == [(None, None)] * 2
