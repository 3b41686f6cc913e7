"""Text of a Word document or a workbook, from its bytes. Small helpers that run inside tasks."""

import posixpath
import re
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _relations(package: ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id to (kind, target part) of a part of the package."""
    folder, name = posixpath.split(part)
    path = posixpath.join(folder, "_rels", f"{name}.rels")
    if path not in package.namelist():
        return {}
    relations = {}
    for node in ElementTree.fromstring(package.read(path)).iter(RELATION):
        if node.get("TargetMode") == "External":
            continue
        target = posixpath.normpath(posixpath.join("/", folder, node.get("Target"))).lstrip("/")
        relations[node.get("Id")] = (node.get("Type").rsplit("/", 1)[-1], target)
    return relations


def _main_part(package: ZipFile, default: str) -> str:
    for kind, target in _relations(package, "").values():
        if kind == "officeDocument":
            return target
    return default


# ---- Word documents ---------------------------------------------------------------------------------


def docx_text(content: bytes) -> str:
    """Paragraphs, then table cells, of the body and of each section's header and footer."""
    with ZipFile(BytesIO(content)) as package:
        main = _main_part(package, "word/document.xml")
        relations = _relations(package, main)
        body = ElementTree.fromstring(package.read(main)).find(f"{W}body")
        pieces = list(_container_texts(body))
        inherited: dict[str, str | None] = {"header": None, "footer": None}
        for section in body.iterfind(f"./{W}p/{W}pPr/{W}sectPr"):
            pieces += _section_texts(package, relations, section, inherited)
        for section in body.iterfind(f"./{W}sectPr"):
            pieces += _section_texts(package, relations, section, inherited)
        return "\n".join(piece for piece in pieces if piece)


def _section_texts(package, relations, section, inherited) -> list[str]:
    """Header and footer of a section; one that is not defined is that of the section before."""
    pieces = []
    for kind in ("header", "footer"):
        for reference in section.iterfind(f"{W}{kind}Reference"):
            if reference.get(f"{W}type") == "default":
                inherited[kind] = relations[reference.get(f"{R}id")][1]
        if inherited[kind]:
            pieces += _container_texts(ElementTree.fromstring(package.read(inherited[kind])))
    return pieces


def _container_texts(container):
    for paragraph in container.iterfind(f"{W}p"):
        yield _paragraph_text(paragraph)
    for table in container.iterfind(f"{W}tbl"):
        above: list = []
        for row in table.iterfind(f"{W}tr"):
            above = _row_cells(row, above)
            for cell in above:
                if cell is not None:
                    yield "\n".join(_paragraph_text(p) for p in cell.iterfind(f"{W}p"))


def _row_cells(row, above: list) -> list:
    """The cell at each grid column; merged cells stand at every column and row they cover."""
    skipped = row.find(f"{W}trPr/{W}gridBefore")
    cells: list = [None] * (int(skipped.get(f"{W}val")) if skipped is not None else 0)
    for cell in row.iterfind(f"{W}tc"):
        span = cell.find(f"{W}tcPr/{W}gridSpan")
        width = int(span.get(f"{W}val")) if span is not None else 1
        merge = cell.find(f"{W}tcPr/{W}vMerge")
        if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(above) > len(cells):
            cell = above[len(cells)]
        cells += [cell] * width
    return cells


def _paragraph_text(paragraph) -> str:
    runs = []
    for child in paragraph:
        if child.tag == f"{W}r":
            runs.append(child)
        elif child.tag == f"{W}hyperlink":
            runs += child.iterfind(f"{W}r")
    return "".join(_run_item(item) for run in runs for item in run)


def _run_item(item) -> str:
    tag = item.tag.removeprefix(W)
    if tag == "t":
        return item.text or ""
    if tag in ("tab", "ptab"):
        return "\t"
    if tag == "cr" or (tag == "br" and item.get(f"{W}type", "textWrapping") == "textWrapping"):
        return "\n"
    return "-" if tag == "noBreakHyphen" else ""


# ---- Workbooks --------------------------------------------------------------------------------------

# Number formats that are dates: the built-in ones by id, others by a date letter outside quotes.
DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}
FORMAT_LITERALS = re.compile(r'"[^"]*"|\\.|_.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]')


def xlsx_text(content: bytes) -> str:
    """A banner per sheet, then one line per row with its cell values."""
    with ZipFile(BytesIO(content)) as package:
        main = _main_part(package, "xl/workbook.xml")
        workbook = ElementTree.fromstring(package.read(main))
        relations = _relations(package, main)
        parts = {kind: target for kind, target in relations.values()}
        shared = _shared_strings(package, parts.get("sharedStrings"))
        dates = _date_styles(package, parts.get("styles"))
        properties = workbook.find(f"{S}workbookPr")
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        lines = []
        for sheet in workbook.iterfind(f"{S}sheets/{S}sheet"):
            kind, part = relations[sheet.get(f"{R}id")]
            if kind != "worksheet":
                continue
            lines.append(f"\n--- Sheet: {sheet.get('name')} ---\n")
            with package.open(part) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if node.tag == f"{S}row":
                        values = [_cell_text(c, shared, dates, from_1904) for c in node.iterfind(f"{S}c")]
                        values = [v for v in values if v is not None]
                        if values:
                            lines.append(" ".join(values))
                        node.clear()
        return "\n".join(lines)


def _rich_text(node) -> str:
    """Plain text or runs of text; phonetic guides are left out."""
    direct = node.findtext(f"{S}t")
    runs = [run.findtext(f"{S}t") or "" for run in node.iterfind(f"{S}r")]
    return (direct or "") + "".join(runs)


def _shared_strings(package: ZipFile, part: str | None) -> list[str]:
    if part is None or part not in package.namelist():
        return []
    return [_rich_text(n) for n in ElementTree.fromstring(package.read(part)).iterfind(f"{S}si")]


def _date_styles(package: ZipFile, part: str | None) -> set[int]:
    """Indexes of the cell styles that show a date or time."""
    if part is None or part not in package.namelist():
        return set()
    styles = ElementTree.fromstring(package.read(part))
    custom = {
        int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iterfind(f"{S}numFmts/{S}numFmt")
    }

    def is_date(format_id: int) -> bool:
        if format_id in custom:
            first = custom[format_id].split(";")[0]
            return re.search("[dmhysDMHYS]", FORMAT_LITERALS.sub("", first)) is not None
        return format_id in DATE_FORMAT_IDS

    formats = [int(n.get("numFmtId", "0")) for n in styles.iterfind(f"{S}cellXfs/{S}xf")]
    return {i for i, format_id in enumerate(formats) if is_date(format_id)}


def _cell_text(cell, shared: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        node = cell.find(f"{S}is")
        return None if node is None else _rich_text(node)
    value = cell.findtext(f"{S}v")
    if value is None or value == "":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(bool(int(value)))
    if kind == "d":
        return str(datetime.fromisoformat(value.removesuffix("Z")))
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    return _date_text(number, from_1904) if int(cell.get("s", "0")) in dates else str(number)


def _date_text(number: float, from_1904: bool) -> str:
    """A day number as a date and time, or as a time where it is less than one day."""
    days, part = divmod(number, 1)
    within_day = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= number < 1 and within_day.days == 0:
        return str((datetime.min + within_day).time())
    if from_1904:
        return str(datetime(1904, 1, 1) + timedelta(days=days) + within_day)
    # Day numbers below 60 are one off, as the day count has a 29 February 1900.
    return str(datetime(1899, 12, 30) + timedelta(days=days + (0 < number < 60)) + within_day)
