"""Document files of all kinds in one folder."""

import zipfile

from tidemark.sources.documents import read_documents

BODY = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
)


def docx(path, paragraphs):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", BODY.format("".join(f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r>{p}</w:r></w:p>" for p in paragraphs)))


def test_every_kind(spark, tmp_path):
    docx(tmp_path / "a.docx", ["<w:t>One &amp; two</w:t>", "", "<w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:delText>gone</w:delText><w:t>é</w:t>"])
    docx(tmp_path / "long.docx", [f"<w:t>line {i}</w:t>" for i in range(20_000)])
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "other.DOCX", "w") as z:
        z.writestr("x", "y")
    (tmp_path / "p.html").write_text("<p class='a'>Hi<br>there</p>")
    (tmp_path / "t.txt").write_bytes("café ".encode() + b"\xff\xfe!")
    (tmp_path / "plain").write_text("no suffix")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "r.pdf").write_bytes(b"%PDF-1.4")
    got = {r["title"]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and "empty.md" not in got
    assert got["a.docx"]["content"] == "One & two\n\nx\ty\né" and got["a.docx"]["error"] is None and got["a.docx"]["doc_type"] == "docx"
    assert got["long.docx"]["content"].count("\n") == 19_999
    assert [(got[n]["content"], got[n]["error"]) for n in ("bad.docx", "other.DOCX")] == [("", "unreadable document: BadZipFile"), ("", "unreadable document: KeyError")]
    assert got["p.html"]["content"] == " Hi there " and got["t.txt"]["content"] == "café !"
    assert (got["plain"]["doc_type"], got["plain"]["content"]) == ("txt", "no suffix")
    assert (got["r.pdf"]["content"], got["r.pdf"]["error"]) == ("", "PDF is not read")
