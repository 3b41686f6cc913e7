"""Which files have text that can be taken out, told from a file's suffix or the first bytes."""

import re

# ---- Fixed values: extensions and MIME types ------------------------------------

TEXT_EXTENSIONS = [
    ".txt", ".html", ".htm", ".css", ".js", ".json", ".xml", ".svg", ".md", ".log", ".csv", ".ini", ".conf",
]
DOCX_EXTENSION = ".docx"
XLSX_EXTENSION = ".xlsx"
PDF_EXTENSION = ".pdf"

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PDF_MIME = "application/pdf"
TEXT_MIME = "text/plain"
ARCHIVE_MIME = "application/zip"
DATA_MIME = "application/octet-stream"

# ------------------------------------------------------------------------------------------------------

# The type of a file without a known suffix is told from so many bytes; the rest may be of any size.
HEAD_BYTES = 1 << 20

ROUTED_SUFFIXES = {*TEXT_EXTENSIONS, DOCX_EXTENSION, XLSX_EXTENSION, PDF_EXTENSION}
# Control characters that no text has.
CONTROL = r"[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]"
_HAS_CONTROL = re.compile(CONTROL.encode()).search


def suffix_of(path: str) -> str:
    """Lower-cased last suffix with its dot, or '' (a name that only begins with a dot has none)."""
    found = re.search(r"[^/](\.[^./]+)\Z", path)
    return found[1].lower() if found else ""


def mime_of_head(head: bytes) -> str:
    """MIME type of a file by its first HEAD_BYTES; `sniff_mime` is the same as a column."""
    if head.startswith(b"%PDF-"):
        return PDF_MIME
    if head.startswith(b"PK\x03\x04"):
        if b"word/" in head:
            return DOCX_MIME
        return XLSX_MIME if b"xl/" in head else ARCHIVE_MIME
    if head.startswith((b"\xff\xfe", b"\xfe\xff")) or not _HAS_CONTROL(head):
        return TEXT_MIME
    return DATA_MIME


def is_routed(path: str, head: bytes, skip_pdf: bool = False) -> bool:
    """Whether a file goes to an extractor, by its suffix or else by its first bytes; PDFs unless `skip_pdf`."""
    suffix = suffix_of(path)
    if suffix in ROUTED_SUFFIXES:
        return suffix != PDF_EXTENSION or not skip_pdf
    mime = mime_of_head(head)
    return mime in (DOCX_MIME, XLSX_MIME, TEXT_MIME) or (mime == PDF_MIME and not skip_pdf)
