"""Readers and writers: every format lands in a DataFrame; bad rows go to a frame of their own."""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ranks

from . import records

SUFFIXES = ("csv", "tsv", "txt", "json", "jsonl", "ndjson", "xml", "parquet", "zip", "xlsx")
BAD = "_corrupt_record"


def opened(spark: SparkSession, path: str):
    """(file system, path, length) of a file, or of the first file of a folder or pattern that has bytes, through the file system that Spark reads; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(where)
    for status in found or ():
        parts = fs.listStatus(status.getPath()) if status.isDirectory() else (status,)
        files = sorted((str(p.getPath()), p) for p in parts if p.isFile() and not p.getPath().getName().startswith(("_", ".")) and p.getLen())
        if files:
            return fs, files[0][1].getPath(), files[0][1].getLen()
    return None


def head(spark: SparkSession, path: str, n: int = 65536) -> bytes:
    """The first bytes of a file in any store that Spark reads; no more of it is read, whatever its size."""
    file = opened(spark, path)
    if file is None:
        return b""
    stream = file[0].open(file[1])
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, file[2])))
    finally:
        stream.close()


def detect_encoding(sample: bytes) -> str:
    """utf-8 with or without a mark, utf-16 if the sample has NUL bytes, else latin-1."""
    if sample[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    if b"\0" in sample:
        return "UTF-16LE" if sample[1:2] == b"\0" else "UTF-16BE"
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def sniff_delimiter(sample: bytes, encoding: str = "UTF-8") -> str:
    """One of , ; tab | : by how evenly it splits the first lines; comma where none does."""
    lines = [x for x in sample.decode(encoding, "replace").splitlines()[:20] if x.strip()]
    if not lines:
        return ","
    best = (0, 0, ",")
    for rank, d in enumerate(",;\t|:"):
        counts = [len(r) for r in csv.reader(lines, delimiter=d)]
        if counts and counts[0] > 1:
            best = max(best, (sum(c == counts[0] for c in counts) * counts[0], -rank, d))
    return best[2]


def _bad_lines(whole: DataFrame, columns: list[str]) -> DataFrame:
    """Lines that did not parse. The condition looks at the parsed columns too: Spark fills the bad-line column only in scans that read others."""
    parsed = F.to_json(F.struct(*columns)) >= ""
    return whole.filter(F.col(f"`{BAD}`").isNotNull() & parsed).select(F.col(f"`{BAD}`").alias("line"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows): delimiter and encoding detected from the head, all-blank rows dropped, malformed records in ``bad`` as text.

    Rows with too few values have nulls for the rest; rows with too many are bad, and so are records
    with bytes outside the encoding or a quote that never closes. Line breaks within quotes belong to the value.
    Empty values are null. An empty file has no rows. One native scan counts quotes and invalid lines
    when the frame is made; files without either are read by Spark's own parser, others record by record (``records``).
    """
    sample = head(spark, path)
    enc = detect_encoding(sample)
    sep = sniff_delimiter(sample, enc)
    names = records.header(sample, enc, sep)
    wanted = T._parse_datatype_string(schema) if schema else T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not names:
        return spark.createDataFrame([], wanted), spark.createDataFrame([], "line string")
    splits = ranks.saved(records.summed(spark, path))
    odd = splits.agg(F.sum("quotes").alias("quotes"), F.sum("broken").alias("broken")).first()
    if enc.startswith("UTF-16") or odd["quotes"] or (enc == "UTF-8" and odd["broken"]):
        unit = {"UTF-16": "UTF-16BE" if sample[:2] == b"\xfe\xff" else "UTF-16LE"}.get(enc, enc)
        good, bad = records.read_records(spark, path, records.Format(unit, sep, names), splits)
        return records.typed(good, bad, wanted) if schema else (good, bad)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", enc).option("quote", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True)
    whole = reader.schema(T.StructType([*wanted.fields, T.StructField(BAD, T.StringType())])).csv(path)
    # Without quotes the delimiters of a line tell its values; a short line is not a bad one.
    text, cells = F.col(f"`{BAD}`"), [F.col(f"`{f.name}`") for f in wanted.fields]
    found = F.size(F.split(text, "\\Q" + sep + "\\E", -1))
    fits = [F.get(F.split(text, "\\Q" + sep + "\\E", -1), F.lit(i)).isin("") | c.isNotNull() | (found <= i) for i, c in enumerate(cells)]
    short = text.isNotNull() & (found < len(cells)) & reduce(lambda a, b: a & b, fits)
    blank = reduce(lambda a, b: a & b, [c.isNull() | (c.cast("string") == "") for c in cells])
    good = whole.filter((text.isNull() | short) & ~blank).select(*cells)
    return good, _bad_lines(whole.filter(text.isNull() | ~short), [f"`{f.name}`" for f in wanted.fields])


def _one_document(sample: bytes) -> bool:
    """Whether JSON starts as one document (an array, or an object that does not end with its first line), not as one object a line."""
    text = sample.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text[:1] != b"{":
        return text[:1] == b"["
    first = text.split(b"\n", 1)[0]
    try:
        json.loads(first)
    except ValueError:
        # A cut or broken first line; a line that only opens an object is the start of a document.
        return first.rstrip()[-1:] in (b"{", b"[", b",", b":")
    return False


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines file, or of one JSON document (array or object) over any number of lines."""
    multi = _one_document(head(spark, path))
    s = T._parse_datatype_string(schema)
    whole = spark.read.schema(T.StructType([*s.fields, T.StructField(BAD, T.StringType())])).option("multiLine", multi).option("columnNameOfCorruptRecord", BAD).json(path)
    cols = [f"`{f.name}`" for f in s.fields]
    return whole.filter(F.col(f"`{BAD}`").isNull()).select(*cols), _bad_lines(whole, cols)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


_XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes):
    """Cells of the first sheet, row by row, as text or None."""
    from xml.etree import ElementTree as E

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_XLSX}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_XLSX}si")]
        sheet = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]
        for _, row in E.iterparse(io.BytesIO(z.read(sheet))):
            if row.tag != f"{_XLSX}row":
                continue
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_XLSX}c")):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = k
                if letters:
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                v = c.find(f"{_XLSX}v")
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_XLSX}t")) or None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook, parsed in tasks (a workbook is one task's work); the first row names the columns, blank rows are skipped."""
    books = spark.read.format("binaryFile").load(path)
    first = books.limit(1).select("content").first()
    header = [str(h) for h in next(iter(_sheet_rows(bytes(first["content"]))))]

    def parse(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = list(_sheet_rows(bytes(content)))[1:]
                rows = [(r + [None] * len(header))[: len(header)] for r in rows if any(x not in (None, "") for x in r)]
                yield pd.DataFrame(rows, columns=header, dtype=object)

    return books.select("content").mapInPandas(parse, T.StructType([T.StructField(h, T.StringType()) for h in header]))


def unzip(spark: SparkSession, path: str, work: str) -> str:
    """Copies the first member of a supported type into the shared folder ``work``, as a stream that holds no more than a buffer of it, and returns its path; ValueError where no member is supported."""
    file = opened(spark, path)
    if file is None:
        raise ValueError(f"no such file: {path}")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(work)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    archive = jvm.java.util.zip.ZipInputStream(file[0].open(file[1]))
    try:
        while (entry := archive.getNextEntry()) is not None:
            name = PurePosixPath(entry.getName())
            if not entry.isDirectory() and name.suffix.lower().lstrip(".") in SUFFIXES and name.suffix.lower() != ".zip" and not name.name.startswith((".", "_")):
                out = jvm.org.apache.hadoop.fs.Path(target, name.name)
                stream = fs.create(out, True)
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(archive, stream)
                finally:
                    stream.close()
                return out.toString()
    finally:
        archive.close()
    raise ValueError("unsupported: no member of a supported type in the archive")


def read_zip(spark: SparkSession, path: str, work: str | None = None, **options) -> DataFrame:
    """The first supported member of a ZIP file, unpacked into the folder ``work`` (a new one beside the checkpoints, if none is named) and read from there as any file of its type."""
    return read_any(spark, unzip(spark, path, work or f"{ranks.shared_folder(spark)}/unzipped-{uuid.uuid4().hex}"), **options)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file by its suffix; an unknown one is a ValueError."""
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type: {suffix or path}")
    if suffix in ("csv", "tsv", "txt"):
        return read_csv(spark, path, options.get("schema"))[0]
    if suffix in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, options["schema"])[0] if "schema" in options else spark.read.option("multiLine", suffix == "json").json(path)
    if suffix == "xml":
        return read_xml(spark, path, options.get("row_tag", "row"), options.get("schema"))
    if suffix == "xlsx":
        return read_xlsx(spark, path)
    if suffix == "zip":
        return read_zip(spark, path, **options)
    return read_parquet(spark, path, options.get("columns"))


def read_full(spark: SparkSession, path: str, rows: int = 200_000, columns: list[str] | None = None, **options) -> DataFrame:
    """At most ``rows`` rows of a file, and of its columns those named that it has."""
    df = read_any(spark, path, **options)
    return (df if columns is None else df.select(*[f"`{c}`" for c in columns if c in df.columns])).limit(rows)


def from_csv_text(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a CSV text that a caller holds, all columns as strings; quoted line breaks are kept, blank rows skipped, short rows filled with nulls."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(x.strip() for x in r)]
    if not rows:
        raise ValueError("no rows in the CSV text")
    names, width = [c.strip().lstrip("﻿") for c in rows[0]], len(rows[0])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple((x or None) for x in (r + [""] * width)[:width]) for r in rows[1:]], schema)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The page of ``size`` rows with the given number, from 1, in a total order."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options) -> DataFrame:
    """A database table over JDBC, read in ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def _cells(df: DataFrame) -> DataFrame:
    """Every value as text, booleans as true and false."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header and CRLF line ends; booleans as true and false, nulls as nothing. Spark's files have no byte order mark; ``csv_bytes`` has."""
    _cells(df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames under the union of their columns, in the order in which they are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def csv_lines(df: DataFrame):
    """Small results as CSV lines, streamed partition by partition."""
    cell = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    def line(values: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n").writerow(values)
        return out.getvalue()

    yield line(df.columns)
    for r in df.toLocalIterator():
        yield line([cell(v) for v in r])


def csv_bytes(df: DataFrame) -> bytes:
    """A small result as one UTF-8 CSV file with a byte order mark."""
    return "".join(csv_lines(df)).encode("utf-8-sig")


def export(df: DataFrame, kind: str) -> bytes:
    """A small result as the bytes of a csv or xlsx file; ValueError for other kinds, pdf among them."""
    if kind == "csv":
        return csv_bytes(df)
    if kind == "xlsx":
        return xlsx_bytes(df)
    raise ValueError(f"unsupported export: {kind}")


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
}


def xlsx_bytes(df: DataFrame, most_rows: int = 100_000) -> bytes:
    """A small result as a workbook: a header, then the rows, streamed partition by partition; more than ``most_rows`` is a ValueError."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = str(v).lower() if isinstance(v, bool) else str(v)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    rows, out = [list(df.columns)], io.BytesIO()
    for r in df.limit(most_rows + 1).toLocalIterator():
        rows.append(list(r))
        if len(rows) > most_rows + 1:
            raise ValueError(f"over {most_rows} rows: write CSV or Parquet")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_XLSX[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def append_job(df: DataFrame, path: str, job: int) -> None:
    """Writes one import job's rows; running the job again replaces them and nothing else."""
    df.withColumn("import_job_id", F.lit(job)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_job_id").parquet(path)
