"""A small reader of XLSX sheets with the standard library alone."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates. Fixed values.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime.datetime(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _active_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_NS}bookViews/{_NS}workbookView")
    sheet = root.findall(f"{_NS}sheets/{_NS}sheet")[int(view.get("activeTab", 0)) if view is not None else 0]
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(_REL))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(f"{_NS}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{_NS}v")
    if kind == "inlineStr":
        return _text(cell)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        at = _EPOCH + datetime.timedelta(days=float(v.text))
        return at.date().isoformat()
    if kind == "n":
        number = float(v.text)
        return str(int(number)) if number.is_integer() and "e" not in v.text.lower() else v.text
    return v.text


def rows(payload: bytes) -> Iterator[list[str | None]]:
    """Rows of the active sheet as canonical texts; wholly empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(payload)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = _date_styles(book)
        with book.open(_active_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(node.findall(f"{_NS}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at - len(out)) + [_value(cell, shared, dates)]
                if any(v not in (None, "") for v in out):
                    yield out
                node.clear()


def write(header: list[str], data: list[list[str]]) -> bytes:
    """A minimal workbook with inline texts, for generated files and tests."""
    from xml.sax.saxutils import escape

    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r) + "</row>" for r in [header, *data])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()
