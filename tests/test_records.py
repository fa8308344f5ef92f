"""Delimited files read in ranges of a few hundred bytes against Python's csv module over the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, records


@pytest.fixture
def narrow(spark):
    """Ranges of 211 bytes, so that many records cross a border."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain(text, sep, width):
    """(rows, bad rows) of csv.reader, short rows filled, long ones bad, blank ones dropped."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[1:]
    good = [tuple((x or None) for x in r + [""] * (width - len(r))) for r in rows if any(r) and len(r) <= width]
    return sorted(good, key=str), sum(len(r) > width for r in rows)


def values(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_text(rng, sep, n=45):
    """Fields with line breaks, delimiters, quotes at odd places, letters whose UTF-16 code units hold the bytes of a line feed, and astral letters."""
    marks = ["\n", "\r\n", sep, '""', "é", "Ċ", "ਊ", "ऊ", "\U0001040a", "word", " ", "\U0001f60a", "x" * 40]
    field = lambda: "".join(rng.choice(marks) for _ in range(rng.randrange(6)))
    bare = lambda: "".join(rng.choice(["a", "Ċ", 'mid"quote', "é", " ", ""]) for _ in range(rng.randrange(3)))
    lines = [sep.join(["h1", '"h\n2"', "h3"])]
    for _ in range(n):
        cells = [f'"{field()}"' if rng.random() < 0.5 else bare().lstrip('"') for _ in range(rng.choice([3, 3, 3, 3, 2, 4, 1]))]
        lines.append(sep.join(cells))
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "be-mark"])
def test_ranges_read_as_the_whole_file(narrow, tmp_path, encoding):
    rng, sep = random.Random(encoding), ",;\t"[len(encoding) % 3]
    text = random_text(rng, sep)
    (tmp_path / "f.csv").write_bytes(b"\xfe\xff" + text.encode("utf-16-be") if encoding == "be-mark" else text.encode(encoding))
    good, bad = files.read_csv(narrow, str(tmp_path / "f.csv"))
    want, lost = plain(text, sep, 3)
    assert good.columns == ["h1", "h\n2", "h3"]
    assert values(good) == want and bad.count() == lost
    assert records.lines_of(narrow, str(tmp_path / "f.csv")).select("start").distinct().count() >= 5


def test_folders_and_latin_letters(narrow, tmp_path):
    (tmp_path / "d").mkdir()
    texts = [f'a,b\n{k},"é\n{k}"\n' * 1 + "".join(f'{k}{i},"x,\ny{i}"\n' for i in range(30)) for k in range(3)]
    for k, t in enumerate(texts):
        (tmp_path / "d" / f"part-{k}.csv").write_bytes(t.encode("latin-1"))
    good, bad = files.read_csv(narrow, str(tmp_path / "d"))
    assert values(good) == sorted((r for t in texts for r in plain(t, ",", 2)[0]), key=str) and bad.isEmpty()


def test_the_probes_of_malformed_files(narrow, tmp_path):
    def read(raw, schema=None):
        (tmp_path / "f.csv").write_bytes(raw)
        good, bad = files.read_csv(narrow, str(tmp_path / "f.csv"), schema)
        return values(good), sorted(r["line"] for r in bad.collect())

    assert read(b'a,b\n1,"x\ny"\n') == ([("1", "x\ny")], [])
    assert read("a,b\n1,é\n".encode("utf-16")) == ([("1", "é")], [])
    late = b"a,b\n" + b"1,good line\n" * 6000 + b"2,caf\xe9\n3,ok\n"
    good, bad = read(late)
    assert len(good) == 6001 and ("3", "ok") in good and bad == ["2,caf\\xe9"]
    assert read(b"") == ([], []) and read(b"a,b\n") == ([], [])
    assert read(b'a,b\n1,2\n3,"open\n4,5\n') == ([("1", "2")], ['3,"open\n4,5'])
    assert read(b"a,b\n1\n,\n\n2,3\n1,2,3\n") == ([("1", None), ("2", "3")], ["1,2,3"])
    assert read(b'a,b\n1,"2"\nx,"3"\n4,"y"\n5\n', "a int, b int") == ([(1, 2), (5, None)], ['{"a":"4","b":"y"}', '{"a":"x","b":"3"}'])
    assert read(b"a,b\n1,2\nx,3\n5\n,\n", "a int, b int") == ([(1, 2), (5, None)], ["x,3"])
    assert read(b'a,a,\n1,"2",3\n')[0] == [("1", "2", "3")]


def test_very_long_records_are_bad_in_pieces(narrow, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_BYTES", 300)
    (tmp_path / "f.csv").write_text('a,b\n1,2\n3,"' + "long\n" * 200 + '"\n4,5\n')
    good, bad = files.read_csv(narrow, str(tmp_path / "f.csv"))
    assert values(good) == [("1", "2"), ("4", "5")] and "".join(sorted((r["line"] for r in bad.collect()), key=lambda x: x[:1] != "3")).count("long") == 200


def test_typed_and_plain_reads_agree(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a;b\n1;x\n2;y\n")
    (tmp_path / "q.csv").write_text('a;b\n1;"x"\n2;y\n')
    one, two = (values(files.read_csv(spark, str(tmp_path / f), "a int, b string")[0]) for f in ("p.csv", "q.csv"))
    assert one == two == [(1, "x"), (2, "y")]


def test_archives_need_no_folder(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("f.csv", 'a,b\n1,"x\ny"\n')
    assert values(files.read_any(spark, str(tmp_path / "a.zip"))) == [("1", "x\ny")]
    assert files.read_any(spark, str(tmp_path / "a.zip")).select(F.length("b")).first()[0] == 3
