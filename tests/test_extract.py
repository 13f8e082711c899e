import io
import zipfile
import zlib

import pytest

from folioscope.sources.extract import decoded, delimited, extract, extracted, looks_binary, plain_rtf, sniffed
from folioscope.sources.files import read_folder, skipped, walked


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
CORE = '<c:coreProperties xmlns:c="urn:c" xmlns:dc="urn:dc"><dc:title>Plan &amp; more</dc:title><dc:creator>Ann</dc:creator></c:coreProperties>'


def test_docx():
    body = f"<w:document {W}><w:p><w:t>One</w:t><w:tab/><w:t>two &lt;</w:t></w:p><w:p><w:t>x</w:t><w:br/><w:t>y</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>cell</w:t></w:p></w:tc></w:tr></w:tbl></w:document>"
    r = extract("a/b.docx", zipped(**{"word__document.xml": body, "docProps__core.xml": CORE}))
    assert (r["kind"], r["extract_method"], r["text"], r["meta"]) == ("document", "docx", "One\ttwo <\nx\ny\ncell", {"title": "Plan & more", "author": "Ann"}) and r["title"] == "One\ttwo <"


def test_pptx_in_the_order_of_numbers():
    slide = lambda t: f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:t>{t}</a:t></a:p></p:sld>'
    r = extract("d.pptx", zipped(**{"ppt__slides__slide10.xml": slide("ten"), "ppt__slides__slide2.xml": slide("• Title two")}))
    assert (r["title"], r["text"], r["meta"]["slides"]) == ("Title two", "Slide 1:\n• Title two\n\nSlide 2:\nten", "2")


def test_xlsx():
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="Budget 26" r:id="r1"/><sheet name="Empty" r:id="r9"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>'
    rows = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>sum</t></is></c></row><row><c r="A2"><v>1.5</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>'
    r = extract("b.xlsx", zipped(**{"xl__workbook.xml": book, "xl___rels__workbook.xml.rels": rels, "xl__worksheets__s1.xml": rows, "xl__sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>"}))
    assert r["kind"] == "spreadsheet" and r["title"] == "Budget 26" and r["text"] == 'Sheet "Budget 26": 1 rows x 3 columns\nname | column 2 | sum\n1.5 |  | 7'
    assert r["table_profile"] == {"sheet": "Budget 26", "n_rows": 1, "cols": [{"name": "name", "samples": ["1.5"]}, {"name": "column 2", "samples": []}, {"name": "sum", "samples": ["7"]}]}


def test_odf_archive_and_pdf():
    r = extract("x.odt", zipped(**{"content.xml": '<o xmlns:text="urn:t"><text:h>Head</text:h><text:p>a<text:tab/>b</text:p></o>'}))
    assert r["text"] == "Head\na\tb"
    assert extract("x.zip", zipped(a="1", d__b="2"))["text"] == "Archive with 2 files:\na\nd/b"
    page = b"BT /F1 12 Tf 72 700 Td (Invoice \\(no. 7\\)) Tj 0 -14 Td [(To)-20(tal)-300(9)] TJ ET"
    packed = zlib.compress(page)
    data = b"%%PDF-1.4\n1 0 obj <</Length %d /Filter /FlateDecode>>\nstream\n" % len(packed) + packed + b"\nendstream endobj\n2 0 obj <</Length 5>>\nstream\nBT <414243> Tj ET\nendstream"
    r = extract("x.pdf", data)
    assert r["text"] == "Invoice (no. 7)\nTotal 9\nABC" and r["extract_method"] == "pdf"
    assert extract("y.pdf", b"%PDF")["extract_method"] == "name-only"


def test_delimited():
    assert delimited('a,"b ""x"" \n,c",d\r\n\r\n , \n1,2"3,', ",") == [["a", 'b "x" \n,c', "d"], ["1", '2"3', ""]]
    assert delimited("", ",") == [] and sniffed("a;b;c\n1,2;3;4") == ";" and sniffed("") == ","
    rows = "id;name\n" + "\n".join(f"{k};n{k % 3}" for k in range(40))
    r = extract("t.csv", rows.encode())
    assert r["title"] == "Table of 40 rows: id, name" and "[... 12 rows skipped ...]" in r["text"] and r["text"].endswith("37 | n1\n38 | n2\n39 | n0")
    assert r["table_profile"]["cols"][1]["samples"] == ["n0", "n1", "n2"]


def test_mail():
    raw = (
        "From: =?UTF-8?B?QW5uw6k=?= <a@x.example>\r\nSubject: =?utf-8?Q?Caf=C3=A9_plan?=\r\n folded\r\nIn-Reply-To: <1@x>\r\nContent-Type: multipart/mixed; boundary=\"B\"\r\n\r\nignored\r\n--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n--C\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: base64\r\n\r\nPHA+SGkgPGI+eW91PC9iPjwvcD4=\r\n--C--\r\n"
        '--B\r\nContent-Disposition: attachment; filename="a.pdf"\r\n\r\nxx\r\n--B--\r\n'
    )
    r = extract("m.eml", raw.encode())
    assert r["title"] == "Café plan folded" and r["text"].split("\n\n")[1:] == ["Hi you", "Attachments: a.pdf"] and r["text"].startswith("From: Anné <a@x.example>\nSubject:") and r["meta"]["in-reply-to"] == "<1@x>"
    q = extract("q.eml", b"Subject: s\nContent-Transfer-Encoding: quoted-printable\n\nCaf=C3=A9 =\nau lait")
    assert q["text"] == "Subject: s\n\nCafé au lait"


def test_markup_and_encodings():
    r = extract("p.html", "<html><title>A &amp; B</title><script>no</script><p>one<br>two</p>&eacute;</html>".encode())
    assert (r["kind"], r["title"], r["text"]) == ("web", "A & B", "A & B\none\ntwo\né")
    assert plain_rtf(r"{\rtf1{\*\gen x;}Caf\'e9\par next\b0 bold}") == "Café\n nextbold"
    assert decoded("é".encode("utf-16")) == "é" and decoded(b"\xef\xbb\xbfx") == "x" and decoded(b"\xe9 " * 10) == "é " * 10 and decoded(b"abc\xff") == "abc�"
    assert looks_binary(b"a\0b") and looks_binary(b"\1" * 20 + b"a" * 50) and not looks_binary("x".encode("utf-16")) and not looks_binary(b"")


@pytest.mark.parametrize("path, data, kind, method, error", [("e.txt", b"", "empty", "empty", False), ("b.docx", b"no zip", "binary", "name-only", True), ("b.docx", zipped(a="1"), "binary", "name-only", True), ("u.bin", b"\0\1", "binary", "name-only", False), ("i.png", b"x", "image", "name-only", False), ("noext", b"plain text", "text", "text", False), ("c.py", b"x = 1", "code", "text", False), (".env", b"A=1", "text", "text", False)])
def test_nothing_fails(path, data, kind, method, error):
    r = extract(path, data)
    assert (r["kind"], r["extract_method"], r["extract_error"] is not None) == (kind, method, error)


def test_folders(spark, tmp_path):
    for name, data in {"b/z.txt": "z", "b/a.txt": "", ".hidden": "h", "_under.md": "u", "node_modules/x.js": "no", "c.TMP": "no", "skip/me.txt": "s"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    (tmp_path / "link").symlink_to(tmp_path / "_under.md")
    (tmp_path / "ö 'q'.txt").write_text("ö")
    got = [(r["path"], r["size"], bytes(r["content"])) for r in read_folder(spark, str(tmp_path), skip=(str(tmp_path / "skip"),)).orderBy("ord").collect()]
    assert [g[0] for g in got] == [".hidden", "_under.md", "b/a.txt", "b/z.txt", "ö 'q'.txt"] and got[2][1:] == (0, b"")
    assert skipped(str(tmp_path)) == [("link", "symlink")] and [p for _, p, _, r in walked(str(tmp_path), skip=(str(tmp_path / "b"),)) if not r][-1] == "ö 'q'.txt"
    assert read_folder(spark, str(tmp_path), limit=2).count() == 2
    rows = {r["path"]: r for r in extracted(read_folder(spark, str(tmp_path))).collect()}
    assert rows["b/a.txt"]["kind"] == "empty" and rows["_under.md"]["text"] == "u" and len(rows["_under.md"]["sha256"]) == 64
    assert extracted(spark.createDataFrame([("x.txt", None, 5)], "path string, content binary, size int")).first()["kind"] == "empty"
