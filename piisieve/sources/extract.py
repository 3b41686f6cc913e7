"""From files with content to documents with text and a status."""

import logging
from collections.abc import Callable, Iterator
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DOCUMENT_SCHEMA
from .office import docx_text, xlsx_text
from .routing import (
    ARCHIVE_MIME, CONTROL, DATA_MIME, DOCX_EXTENSION, DOCX_MIME, HEAD_BYTES, PDF_EXTENSION, PDF_MIME, TEXT_EXTENSIONS,
    TEXT_MIME, XLSX_EXTENSION, XLSX_MIME,
)

log = logging.getLogger(__name__)

# ---- Fixed values: encodings and messages --------------------------------------------------------------

# Tried in this order, strictly, after UTF-8; the last one takes any bytes.
LEGACY_ENCODINGS = ["big5", "gbk", "latin-1"]

EMPTY_FILE = "空檔案"
UNSUPPORTED_TYPE = "不支援的檔案類型"
UNKNOWN_MIME = "未知"
BROKEN_FILE = "檔案可能已加密或已損毀，無法解析。"
DOCX_ERROR = "解析 DOCX 檔案時發生錯誤: "

# ------------------------------------------------------------------------------------------------------

NO_PDF_EXTRACTOR = "no PDF extractor was given"


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or '' (a name that only begins with a dot has none)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def route_by_extension(path: Column) -> Column:
    """docx, xlsx, pdf or text; NULL for other extensions."""
    suffix = extension(path)
    return (
        F.when(suffix.isin(TEXT_EXTENSIONS), F.lit("text"))
        .when(suffix == DOCX_EXTENSION, F.lit("docx"))
        .when(suffix == XLSX_EXTENSION, F.lit("xlsx"))
        .when(suffix == PDF_EXTENSION, F.lit("pdf"))
    )


def sniff_mime(content: Column) -> Column:
    """MIME type from the first HEAD_BYTES: PDF, the two Office formats, other archives, text, or unknown data."""
    content = F.substring(content, 1, HEAD_BYTES)

    def has(part: str) -> Column:
        return F.contains(content, F.lit(part.encode()))

    # Any byte is one character in this charset, so the check is on bytes.
    as_bytes = F.decode(content, "ISO-8859-1")
    has_control = as_bytes.rlike(CONTROL)
    wide_text = F.startswith(content, F.lit(b"\xff\xfe")) | F.startswith(content, F.lit(b"\xfe\xff"))
    return (
        F.when(F.startswith(content, F.lit(b"%PDF-")), F.lit(PDF_MIME))
        .when(
            F.startswith(content, F.lit(b"PK\x03\x04")),
            F.when(has("word/"), F.lit(DOCX_MIME))
            .when(has("xl/"), F.lit(XLSX_MIME))
            .otherwise(F.lit(ARCHIVE_MIME)),
        )
        .when(~has_control | wide_text, F.lit(TEXT_MIME))
        .otherwise(F.lit(DATA_MIME))
    )


def route_by_mime(mime: Column) -> Column:
    return (
        F.when(mime == DOCX_MIME, F.lit("docx"))
        .when(mime == XLSX_MIME, F.lit("xlsx"))
        .when(mime == PDF_MIME, F.lit("pdf"))
        .when(F.startswith(mime, F.lit("text/")), F.lit("text"))
    )


def _converter(pdf_extractor: Callable[[bytes], str] | None):
    """Arrow function for what Spark cannot decode: legacy encodings, Office files, and PDF if given."""

    @F.arrow_udf("struct<text:string,status:string,message:string>")
    def convert(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, routes in batches:
            rows = [
                None if content is None else _convert(content.as_py(), route, pdf_extractor)
                for content, route in (
                    (c if c.is_valid else None, r)
                    for c, r in zip(contents, routes.to_pylist(), strict=True)
                )
            ]
            yield pa.array(
                rows,
                type=pa.struct(
                    [("text", pa.string()), ("status", pa.string()), ("message", pa.string())]
                ),
            )

    return convert


def _convert(content: bytes, route: str, pdf_extractor: Callable[[bytes], str] | None) -> dict:
    try:
        if route == "text":
            text = _decode_legacy(content)
        elif route == "docx":
            text = docx_text(content)
        elif route == "xlsx":
            text = xlsx_text(content)
        else:
            text = pdf_extractor(content)
        return {"text": text, "status": "COMPLETED", "message": None}
    except Exception as error:
        if route == "xlsx" and isinstance(error, (BadZipFile, KeyError)):
            return {"text": None, "status": "SKIPPED", "message": BROKEN_FILE}
        message = str(error)
        if route == "docx":
            message = BROKEN_FILE if "encrypted" in message.lower() else DOCX_ERROR + message
        return {"text": None, "status": "ERROR", "message": message}


def _decode_legacy(content: bytes) -> str:
    for encoding in LEGACY_ENCODINGS[:-1]:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode(LEGACY_ENCODINGS[-1])


def extract_text(files: DataFrame, pdf_extractor: Callable[[bytes], str] | None = None) -> DataFrame:
    """Documents from files with `path`, `length` and `content`, as the `binaryFile` reader gives them.

    Every file keeps a row with its status. UTF-8 text is decoded by Spark itself; only the content
    of other files is sent to Python. Columns `read_error` and `unreadable`, where present, carry a
    failed read. A PDF is skipped unless `pdf_extractor(content)` is given.
    """
    for name, default in (("read_error", "string"), ("unreadable", "boolean")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(default))
    col = F.col

    known = files.select(
        "path", "length", "content", "read_error", "unreadable",
        route_by_extension(col("path")).alias("known_route"),
    )
    sniffed = known.withColumn(
        "sniffed",
        F.when(col("known_route").isNull() & (F.length("content") > 0), sniff_mime(col("content"))),
    )
    routed = sniffed.withColumn(
        "route", F.coalesce("known_route", route_by_mime(col("sniffed")))
    ).withColumn(
        "is_utf8", (col("route") == "text") & F.is_valid_utf8(col("content").cast("string"))
    )
    in_python = (
        col("route").isin("docx", "xlsx")
        | ((col("route") == "text") & ~col("is_utf8"))
        | ((col("route") == "pdf") & F.lit(pdf_extractor is not None))
    ) & (col("length") > 0)
    converted = routed.withColumn(
        "converted", _converter(pdf_extractor)(F.when(in_python, col("content")), col("route"))
    )

    raw = F.when(col("is_utf8"), col("content").cast("string")).otherwise(col("converted.text"))
    # Text files are read with universal newlines.
    text = F.when(
        (col("route") == "text") & F.contains(raw, F.lit("\r")),
        F.regexp_replace(raw, "\r\n?", "\n"),
    ).otherwise(raw)
    unreadable = F.coalesce(col("unreadable"), F.lit(False))
    outcome = (
        F.when(unreadable, _outcome("ERROR", col("read_error"), "", 0))
        .when(col("length") == 0, _outcome("SKIPPED", F.lit(EMPTY_FILE), "", 0))
        .when(col("read_error").isNotNull(), _outcome("ERROR", col("read_error")))
        .when(col("is_utf8"), _outcome("COMPLETED", F.lit(None)))
        .when(col("converted").isNotNull(), _outcome(col("converted.status"), col("converted.message")))
        .when(col("route") == "pdf", _outcome("SKIPPED", F.lit(NO_PDF_EXTRACTOR)))
        .otherwise(
            _outcome("SKIPPED", F.lit(UNSUPPORTED_TYPE), F.coalesce("sniffed", F.lit(UNKNOWN_MIME)))
        )
    )
    return converted.select(
        "*", text.alias("raw_text"), outcome.alias("outcome")
    ).select(
        col("path").alias("doc_id"),
        col("path").alias("file_path"),
        col("outcome.mime_type").alias("mime_type"),
        col("outcome.file_size_bytes").alias("file_size_bytes"),
        col("outcome.status").alias("status"),
        # A read that breaks off while the type is still unknown is the one error nothing else reports.
        (col("read_error").isNotNull() & ~unreadable & col("known_route").isNull()).alias("failed"),
        col("outcome.error_message").alias("error_message"),
        F.current_timestamp().alias("timestamp_utc"),
        F.when(col("outcome.status") == "COMPLETED", col("raw_text")).alias("text"),
    ).to(DOCUMENT_SCHEMA)


def _outcome(status, message: Column, mime=None, size=None) -> Column:
    by_route = (
        F.when(F.col("route") == "docx", F.lit(DOCX_MIME))
        .when(F.col("route") == "xlsx", F.lit(XLSX_MIME))
        .when(F.col("route") == "pdf", F.lit(PDF_MIME))
        .when(F.col("route") == "text", F.lit(TEXT_MIME))
    )

    def as_column(value, default: Column) -> Column:
        if value is None:
            return default
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        as_column(status, F.lit(None)).cast("string").alias("status"),
        message.cast("string").alias("error_message"),
        as_column(mime, by_route).cast("string").alias("mime_type"),
        as_column(size, F.col("length")).cast("bigint").alias("file_size_bytes"),
    )
