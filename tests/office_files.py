"""Minimal Office files for the tests."""

from io import BytesIO
from xml.sax.saxutils import escape
from zipfile import ZipFile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
DOC_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(parts):
    buffer = BytesIO()
    with ZipFile(buffer, "w") as package:
        for name, content in parts.items():
            package.writestr(name, content)
    return buffer.getvalue()


def _rels(targets):
    items = "".join(
        f'<Relationship Id="{i}" Type="{DOC_RELS}/{kind}" Target="{target}"/>' for i, kind, target in targets
    )
    return f'<Relationships xmlns="{RELS}">{items}</Relationships>'


def paragraph(text):
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def cell(text, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{paragraph(text)}</w:tc>"


def table(*rows):
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(cells)}</w:tr>" for cells in rows) + "</w:tbl>"


def section(references=""):
    return f"<w:sectPr>{references}</w:sectPr>"


def docx(body, headers=None):
    """`headers` maps a relation id to (header or footer, its content)."""
    headers = headers or {}
    parts = {
        "_rels/.rels": _rels([("d", "officeDocument", "word/document.xml")]),
        "word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": _rels([(i, kind, f"{i}.xml") for i, (kind, _) in headers.items()]),
    }
    for i, (kind, content) in headers.items():
        tag = "hdr" if kind == "header" else "ftr"
        parts[f"word/{i}.xml"] = f"<w:{tag} {W}>{content}</w:{tag}>"
    return _zip(parts)


def xlsx(sheets, shared=(), formats=""):
    """`sheets` maps a title to its rows of cells, given as XML."""
    names = "".join(
        f'<sheet name="{escape(title)}" sheetId="{i}" r:id="s{i}"/>' for i, title in enumerate(sheets, 1)
    )
    targets = [(f"s{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]
    parts = {
        "_rels/.rels": _rels([("w", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f"<workbook {S} {R}><sheets>{names}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _rels(
            [*targets, ("ss", "sharedStrings", "sharedStrings.xml"), ("st", "styles", "styles.xml")]
        ),
        "xl/sharedStrings.xml": f"<sst {S}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in shared)}</sst>",
        "xl/styles.xml": f"<styleSheet {S}>{formats}</styleSheet>",
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f"<row>{''.join(cells)}</row>" for cells in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>"
    return _zip(parts)
