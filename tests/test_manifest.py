import pytest

from tidemark.streaming import ingest


def test_a_resume_is_bound_to_what_was_loaded(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.csv").write_text("k,v\n1,x\n1,x\n2,\n3,y,z\n")
    schema = "k int, v string, _corrupt_record string"
    load = lambda: ingest.load_checked(ingest.read_folder(spark, str(source), schema), folder, ["v"], source=str(source)).awaitTermination()
    load()
    (source / "b.csv").write_text("k,v\n4,w\n")
    load()
    rows = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert sorted(r["k"] for r in rows("table").collect()) == [1, 4]
    got = sorted(tuple(r)[:5] for r in rows("metrics").collect())
    assert got == [(1, 1, 0, 0, 0), (4, 1, 1, 1, 1)]
    assert sorted(r["reason"] for r in rows("dead_letters").collect()) == ["malformed", "missing: v"]
    (source / "a.csv").write_text("k,v\n1,x\n1,q\n2,\n3,y,z\n")
    with pytest.raises(ingest.Changed, match="a.csv"):
        load()
    (source / "a.csv").write_text("k,v\n1,x\n1,x\n2,\n3,y,z\n")
    (source / "b.csv").unlink()
    (source / "c.csv").write_text("k,v\n5,w\n")
    assert [f.rsplit("/", 1)[-1] for f in ingest.Manifest(spark, folder).bind(str(source))] == ["c.csv"]
