"""Text, title, table profile and metadata out of files of many formats, one row for each file.

:func:`extract` never fails: a file that can't be read keeps its name, its kind and the reason.  The
formats are opened with the standard library; archives' entries over a limit and files over
another are not opened.  :func:`extracted` runs it over a DataFrame of contents in Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import html
import io
import quopri
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from email.header import decode_header
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = {
    "text": "txt md markdown rst rtf log text nfo tex", "code": "py js mjs cjs ts tsx jsx java go rb php sh bash zsh ps1 sql rs c h cpp hpp cs swift kt scala r m pl lua dart vue svelte css scss",
    "config": "json jsonl ndjson yaml yml toml ini cfg conf env properties xml plist", "table": "csv tsv tab", "web": "html htm xhtml", "email": "eml",
    "image": "png jpg jpeg gif webp heic heif tif tiff bmp svg ico psd ai raw cr2 nef", "media": "mp3 wav m4a aac flac ogg mp4 mov avi mkv webm wmv", "archive": "zip jar",
}
_KIND = {e: k for k, es in KINDS.items() for e in es.split()}
#: Bytes read of a text file; bytes of a container, and of one entry of it, that are opened; rows of a sheet; pages' text of a PDF.
TEXT_BYTES, ZIP_BYTES, ENTRY_BYTES, SHEET_ROWS, PDF_CHARS = 4 << 20, 150 << 20, 64 << 20, 2_000, 200_000

COLUMN = T.StructType([T.StructField("name", T.StringType()), T.StructField("samples", T.ArrayType(T.StringType()))])
PROFILE = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("n_rows", T.IntegerType()), T.StructField("cols", T.ArrayType(COLUMN))])
EXTRACT = T.StructType([
    T.StructField("ext", T.StringType()), T.StructField("size", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("extract_method", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("table_profile", PROFILE), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("extract_error", T.StringType()),
])


def kind_of(ext: str) -> str | None:
    return _KIND.get(ext)


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix[1:].lower()


# ---- plain text


def looks_binary(data: bytes) -> bool:
    """Whether the first 8,000 bytes hold a zero or more than a tenth of control bytes; never with the mark of UTF-16."""
    head = data[:8000]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    seen = Counter(head)
    control = sum(n for b, n in seen.items() if b and (b < 9 or 13 < b < 32))
    return seen[0] > 0 or control > len(head) * 0.1


def decoded(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, or Latin-1 where UTF-8 leaves more than three and one in 200 bytes unread."""
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[2:].decode(codec, "replace")
    text = data.decode("utf-8", "replace").removeprefix(chr(0xFEFF))
    bad = text.count(chr(0xFFFD))
    return data.decode("latin-1") if bad > 3 and bad * 200 > len(text) else text


def first_line(text: str) -> str:
    for line in text.split("\n"):
        s = re.sub(r"^[#>*\-\s]+", "", line).strip()
        if len(s) > 2:
            return s[:120]
    return ""


# ---- tables


def sniffed(text: str) -> str:
    head = "\n".join(text.split("\n")[:5])
    return max(",;\t|", key=head.count)


def delimited(text: str, mark: str) -> list[list[str]]:
    """Rows of fields: quotes open a field only at its start, a doubled quote is one, a quoted field may hold line ends; blank rows are left out."""
    token = re.compile(rf'"((?:[^"]|"")*)(?:"|\Z)([^{re.escape(mark)}\n]*)|([^{re.escape(mark)}\n]*)')
    rows: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    while at <= n:
        m = token.match(text, at)
        # carriage returns count only inside quotes
        row.append(m[3].replace("\r", "") if m[1] is None else m[1].replace('""', '"') + m[2].replace("\r", ""))
        at = m.end()
        if at >= n or text[at] == "\n":
            if any(x.strip() for x in row):
                rows.append(row)
            row = []
        at += 1
    return rows


def tabled(sheets: list[tuple[str, list[list[str]]]], method: str, most: int = 25, cut: bool = False) -> dict:
    """The text, the profile of the first sheet with rows, and the title of a table's sheets."""
    short = lambda r: " | ".join(re.sub(r"\s+", " ", x)[:80] for x in r)
    parts: list[str] = []
    profile = None
    for name, rows in sheets:
        if not rows:
            continue
        header = [h.strip() or f"column {k}" for k, h in enumerate(rows[0], 1)]
        body = rows[1:]
        width = max(len(header), *(len(r) for r in body[:50]), 0) if body else len(header)
        parts.append(f'Sheet "{name}": {len(body)}{"+" if cut else ""} rows x {width} columns')
        parts += map(short, [header, *body[:most]])
        if len(body) > most:
            parts.append(f"[... {max(0, len(body) - most - 3)} rows skipped ...]")
            parts += map(short, body[max(most, len(body) - 3) :])
        if profile is None:
            cols = []
            for k, h in enumerate(header[:60]):
                values = dict.fromkeys(v for r in body if k < len(r) and (v := r[k].strip()))
                cols.append({"name": h, "samples": [v[:60] for v in list(values)[:5]]})
            profile = {"sheet": name, "n_rows": len(body), "cols": cols}
    title = ""
    if profile:
        names = [c["name"] for c in profile["cols"]]
        own = method == "xlsx" and not re.fullmatch(r"(?i)sheet\s*\d*", profile["sheet"])
        title = profile["sheet"] if own else f"Table of {profile['n_rows']} rows: {', '.join(names[:5])}{', …' if len(names) > 5 else ''}"
    return {"kind": "spreadsheet" if method == "xlsx" else "table", "extract_method": method, "title": title, "text": "\n".join(parts), "table_profile": profile, "meta": {"sheets": ", ".join(n for n, _ in sheets)}}


# ---- markup


def plain_html(markup: str) -> str:
    t = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->", " ", markup)
    t = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n", t)
    t = html.unescape(re.sub(r"(?s)<[^>]+>", " ", t).replace("&nbsp;", " ")).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\r?\n *", "\n", re.sub(r"[ \t]+", " ", t))).strip()


def html_title(markup: str) -> str:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", markup)
    return html.unescape(m[1]).strip() if m else ""


def plain_rtf(rtf: str) -> str:
    """Paragraph marks as line ends, escaped bytes as characters, groups and control words dropped."""
    marks = re.compile(r"\\par(?:d)?(?![a-z])|\\'([0-9a-fA-F]{2})|\{\\\*[^{}]*\}|\\[a-zA-Z]+-?\d* ?|[{}]")
    out = marks.sub(lambda m: "\n" if m[0].startswith("\\par") else bytes.fromhex(m[1]).decode("latin-1") if m[1] else "", rtf)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


# ---- mail


def _fields(head: str) -> dict[str, str]:
    out = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", head).splitlines():
        name, colon, value = line.partition(":")
        if colon and re.fullmatch(r"[\w\-]+", name):
            out[name.lower()] = value.strip()
    return out


def _words(value: str) -> str:
    try:
        return "".join(x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x, _ in decode_header(value))
    except (ValueError, binascii.Error):
        return value


def _transferred(fields: dict[str, str], body: str) -> str:
    how = fields.get("content-transfer-encoding", "").lower()
    if how == "base64":
        try:
            return base64.b64decode(re.sub(r"\s+", "", body) + "==").decode("utf-8", "replace")
        except binascii.Error:
            return body
    if how == "quoted-printable":
        return quopri.decodestring(body.encode("utf-8")).decode("utf-8", "replace")
    return body


def _cut(raw: str) -> tuple[str, str]:
    m = re.search(r"\r?\n\r?\n", raw)
    return (raw[: m.start()], raw[m.end() :]) if m else (raw, "")


def mail_body(fields: dict[str, str], body: str, depth: int = 0) -> str:
    """The plain part, else the markup's text, else the first nested part; attachments' names follow."""
    kind = fields.get("content-type", "text/plain")
    mark = re.search(r'boundary="?([^";]+)"?', kind, re.I)
    if not mark or depth > 8:
        text = _transferred(fields, body)
        return plain_html(text) if "text/html" in kind.lower() else text
    parts = []
    for piece in body.split(f"--{mark[1]}")[1:]:
        if not piece.startswith("--"):
            head, inner = _cut(piece.lstrip("\r\n"))
            parts.append((_fields(head), inner.strip()))
    of = lambda t: next((p for p in parts if t in p[0].get("content-type", "").lower()), None)
    main = ""
    if p := of("text/plain"):
        main = _transferred(*p)
    elif p := of("text/html"):
        main = plain_html(_transferred(*p))
    elif p := of("multipart/"):
        main = mail_body(*p, depth + 1)
    names = [m[1] for f, _ in parts if (m := re.search(r'filename="?([^";]+)"?', f.get("content-disposition", ""), re.I))]
    return f"{main}\n\nAttachments: {', '.join(names)}" if names else main


def mail(raw: str) -> dict:
    head, body = _cut(raw)
    fields = {k: _words(v) for k, v in _fields(head).items()}
    top = "\n".join(f"{k.capitalize()}: {fields[k]}" for k in ("from", "to", "cc", "date", "subject") if fields.get(k))
    meta = {k: fields[k] for k in ("from", "date", "subject", "message-id", "in-reply-to", "references") if fields.get(k)}
    return {"kind": "email", "extract_method": "eml", "title": fields.get("subject", ""), "text": f"{top}\n\n{mail_body(fields, body.lstrip())}".strip(), "meta": meta}


# ---- containers


def _entry(z: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > ENTRY_BYTES:
        raise ValueError(f"{name} is too large")
    return z.read(info)


def _tree(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    data = _entry(z, name)
    return None if data is None else ElementTree.fromstring(data)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _flowed(root: ElementTree.Element, text_tags: set[str] | None, marks: dict[str, str]) -> str:
    """The text of a tree in document order: of all elements or of some, with a mark at each end of others."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        tag = _tag(e)
        if e.text and (text_tags is None or tag in text_tags):
            out.append(e.text)
        for child in e:
            walk(child)
            if child.tail and text_tags is None:
                out.append(child.tail)
        if tag in marks:
            out.append(marks[tag])

    walk(root)
    return "".join(out)


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    root = _tree(z, "docProps/core.xml")
    names = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
    return {} if root is None else {names[_tag(e)]: e.text.strip() for e in root if _tag(e) in names and e.text and e.text.strip()}


def docx(z: zipfile.ZipFile) -> dict:
    root = _tree(z, "word/document.xml")
    if root is None:
        raise ValueError("no word/document.xml")
    meta = _core(z)
    return {"kind": "document", "extract_method": "docx", "text": _tidy(_flowed(root, {"t"}, {"tab": "\t", "br": "\n", "cr": "\n", "p": "\n", "tc": "\t"})), "meta": meta}


def pptx(z: zipfile.ZipFile) -> dict:
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    parts = [_tidy(_flowed(_tree(z, n), {"t"}, {"p": "\n", "br": "\n"})) for _, n in slides]
    title = next((re.sub(r"^[•\-\s]+", "", x)[:120] for x in (parts[0].split("\n") if parts else []) if x.strip()), "")
    return {"kind": "presentation", "extract_method": "pptx", "title": title, "text": "\n\n".join(f"Slide {k}:\n{p}" for k, p in enumerate(parts, 1)), "meta": _core(z) | {"slides": str(len(parts))}}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    root = _tree(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in (root if root is not None else []) if _tag(si) == "si"]
    rels = _tree(z, "xl/_rels/workbook.xml.rels")
    at = {r.get("Id"): r.get("Target") or "" for r in (rels if rels is not None else [])}
    book = _tree(z, "xl/workbook.xml")
    out = []
    for s in book.iter() if book is not None else []:
        if _tag(s) != "sheet":
            continue
        place = at.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None), "")
        page = _tree(z, place[1:] if place.startswith("/") else "xl/" + place.removeprefix("./"))
        rows: list[list[str]] = []
        for row in page.iter() if page is not None else []:
            if _tag(row) != "row":
                continue
            if len(rows) >= SHEET_ROWS:
                break
            cells: dict[int, str] = {}
            for c in row:
                values = {_tag(x): x for x in c}
                kind = c.get("t")
                if kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                elif "v" in values:
                    v = values["v"].text or ""
                    v = shared[int(v)] if kind == "s" else v
                else:
                    continue
                cells[_column(c.get("r")) if c.get("r") else len(cells)] = v
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        out.append((s.get("name") or "Sheet", rows))
    return out


def odf(z: zipfile.ZipFile, ext: str) -> dict:
    root = _tree(z, "content.xml")
    if root is None:
        raise ValueError("no content.xml")
    kind = {"ods": "spreadsheet", "odp": "presentation"}.get(ext, "document")
    return {"kind": kind, "extract_method": "odf", "text": _tidy(_flowed(root, None, {"tab": "\t", "line-break": "\n", "p": "\n", "h": "\n", "table-cell": "\t", "table-row": "\n"}))}


def listed(z: zipfile.ZipFile) -> dict:
    names = [n for n in dict.fromkeys(z.namelist()) if not n.endswith("/")]
    return {"kind": "archive", "extract_method": "zip-listing", "text": "\n".join([f"Archive with {len(names)} files:", *names[:200]])}


# ---- PDF

_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+|/\S+", re.S)


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")
    t = token[1:-1].decode("latin-1")
    return re.sub(r"\\([0-7]{1,3}|\r?\n|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else "" if m[1].strip() == "" and "\n" in m[1] else _ESCAPED.get(m[1], m[1]), t, flags=re.S)


def shown(stream: bytes) -> str:
    """The text that a page's stream shows: strings, a blank for wide kerning, a line's end where the place moves down."""
    out: list[str] = []
    stack: list[bytes] = []
    array: list[str] | None = None
    for m in _TOKEN.finditer(stream):
        x = m[0]
        if x == b"[":
            array = []
        elif x == b"]":
            stack.append(b"]")
        elif x[:1] in b"(<" and x[:1]:
            if array is not None and stack[-1:] != [b"]"]:
                array.append(_string(x))
            else:
                stack.append(x)
        elif re.fullmatch(rb"-?\d*\.?\d+", x):
            if array is not None and stack[-1:] != [b"]"]:
                if float(x) < -200:
                    array.append(" ")
            else:
                stack.append(x)
        else:
            if x == b"TJ" and array is not None:
                out.append("".join(array))
            elif x in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in (b"(", b"<"):
                out.append(("\n" if x != b"Tj" else "") + _string(stack[-1]))
            elif x in (b"T*", b"ET") or (x in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1] if stack[-1][:1] not in (b"(", b"<", b"]") else 0) != 0):
                out.append("\n")
            elif x in (b"Td", b"TD"):
                out.append(" ")
            stack, array = [], None
    return "".join(out)


def pdf(data: bytes) -> dict:
    """The text of a file's uncompressed and deflated streams; a file without any is known by its name only."""
    out, total = [], 0
    for m in re.finditer(rb"stream\r?\n", data):
        stop = data.find(b"endstream", m.end())
        head = data[max(0, data.rfind(b"obj", 0, m.start())) : m.start()]
        raw = data[m.end() : stop if stop >= 0 else len(data)]
        if b"FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" in raw and (t := shown(raw).strip()):
            out.append(t)
            total += len(t)
            if total > PDF_CHARS:
                break
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    return {"kind": "document", "extract_method": "pdf" if text else "name-only", "text": text, "meta": {} if text else {"note": "no text layer"}}


# ---- all formats

_OFFICE = {"docx": docx, "docm": docx, "dotx": docx, "pptx": pptx, "pptm": pptx, "potx": pptx}


def _read(path: str, ext: str, data: bytes, most: int) -> dict:
    kind = kind_of(ext)
    if ext in _OFFICE or ext in ("xlsx", "xlsm", "xltx", "odt", "ods", "odp") or kind == "archive":
        if len(data) > ZIP_BYTES:
            return {"kind": "binary", "extract_method": "name-only", "meta": {"note": "too large to open"}}
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if ext in _OFFICE:
                return _OFFICE[ext](z)
            if ext.startswith("xl"):
                return tabled(sheets(z), "xlsx", most)
            return odf(z, ext) if ext.startswith("od") else listed(z)
    if ext == "pdf":
        return pdf(data)
    if kind in ("image", "media"):
        return {"kind": kind, "extract_method": "name-only"}
    head = data[:TEXT_BYTES]
    if kind is None and looks_binary(head):
        return {"kind": "binary", "extract_method": "name-only"}
    raw = decoded(head)
    if kind == "table":
        return tabled([(PurePosixPath(path).name, delimited(raw, sniffed(raw) if ext == "csv" else "\t"))], ext, most, len(data) > TEXT_BYTES)
    if kind == "email":
        return mail(raw)
    if kind == "web":
        return {"kind": "web", "extract_method": "html", "title": html_title(raw), "text": plain_html(raw)}
    if ext == "rtf":
        return {"kind": "document", "extract_method": "rtf", "text": plain_rtf(raw)}
    return {"kind": "code" if kind in ("code", "config") else "text", "extract_method": "text", "text": raw}


def extract(path: str, data: bytes, most: int = 25) -> dict:
    """What a file holds; an empty file is of kind empty, one that can't be read is known by its name only, with the reason."""
    ext = suffix(path)
    out = {"ext": ext, "size": len(data), "kind": "empty", "extract_method": "empty", "title": "", "text": "", "table_profile": None, "meta": {}, "extract_error": None}
    if not data:
        return out
    try:
        out |= _read(path, ext, data, most)
    except Exception as x:  # noqa: BLE001  any fault in a file is a fact about the file
        out |= {"kind": kind_of(ext) or "binary", "extract_method": "name-only", "extract_error": (str(x) or type(x).__name__)[:200]}
    return out | {"title": (out["title"] or first_line(out["text"]))[:160]}


def extracted(files: DataFrame, path_col: str = "path", content_col: str = "content", most: int = 25) -> DataFrame:
    """The files' columns but their content, with the columns of EXTRACT; a null content counts as an empty file."""
    kept = [f for f in files.schema if f.name != content_col and f.name not in EXTRACT.fieldNames()]
    names = [f.name for f in kept]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([extract(p, bytes(d) if d is not None else b"", most) for p, d in zip(b[path_col], b[content_col])], columns=EXTRACT.fieldNames())
            yield pd.concat([b[names].reset_index(drop=True), got], axis=1)

    return files.select(*names, content_col).mapInPandas(scan, T.StructType([*kept, *EXTRACT.fields]))
