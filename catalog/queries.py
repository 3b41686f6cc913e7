"""One query per operator, each over whole tables.

The tables hold few of the numbers and none of the Chinese keywords that the detectors look for, so the
template queries write such text from the keys of `orders`, and the file queries write files from
`documents`. Both grow with their tables.
"""

import re
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.sax.saxutils import escape, quoteattr
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisieve import (
    NameDetector, PythonDetector, RuleDetector, extract_text, findings_of, list_files, read_files,
    scan, scan_documents, to_report,
)
from piisieve.functions.matches import context_window, find_matches
from piisieve.functions.scoring import mask_value, risk_tier
from piisieve.functions.validators import luhn_valid, national_id_valid
from piisieve.operators.builtin import BUILTIN
from piisieve.operators.segments import scan_segments
from piisieve.operators.names import (
    CHUNK_STEP, chunk_text, clean_entities, locate_entities, merge_touching,
)
from piisieve.plans.report import count_failed, count_findings, scan_totals
from piisieve.schema import status_label, validation_label
from piisieve.sources.extract import extension, route_by_extension
from piisieve.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
KEYS_PER_TASK = 100_000
DETECTORS = {d.pii_type: d for d in BUILTIN}
FINDING_COLUMNS = [
    "pii_type", "matched_value", "confidence_score", "scanner_source", "validation_status",
    "context", "location", "start_pos",
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), spark)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


def order_keys(spark, sf_dir):
    """Each key becomes a text, so no task gets many of them, however the file is cut."""
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), spark, rows_per_task=KEYS_PER_TASK)


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


# ---- Detectors on the driver's own text ---------------------------------------------------------------


def detector_query(source, *pii_types: str) -> Query:
    chosen = [DETECTORS[t] for t in pii_types]
    return lambda spark, sf_dir: scan(source(spark, sf_dir), keep=["doc_id"], detectors=chosen or None)


def scan_documents_in_segments(spark, sf_dir):
    """All seven detectors over `documents`, each text cut into segments of about 4 096 characters."""
    return scan_segments(documents(spark, sf_dir), keep=["doc_id"], size=4096)


def scan_subset(spark, sf_dir):
    names = ["regexemailscanner", "RegexPassportScanner", "RegexEmailScanner", "NoSuchScanner"]
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=names)


# ---- Detectors on text written from keys ---------------------------------------------------------------


def _padded(width: int) -> Column:
    return F.lpad(F.col("o_orderkey").cast("string"), width, "0")


def _digits8(value: Column) -> Column:
    return F.lpad((value % 100000000).cast("string"), 8, "0")


def _branches(count: int, *texts: Column) -> Column:
    branch = F.col("o_orderkey") % count
    chosen = F.when(branch == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        chosen = chosen.when(branch == i, text)
    return chosen


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def nhi_text() -> Column:
    n = _padded(12)
    return _branches(
        6,
        _text("健保卡 ", n, " 完"),
        _text("訂單號：", n),
        _text("健保卡訂單號：", n),
        _text("資料 ", n, "。"),
        _text("資料 ", n, "9"),
        _text("健保卡", "文" * 30, "：", n, "：", "字" * 30),
    )


def passport_text() -> Column:
    n = _padded(9)
    return _branches(
        4, _text("護照 ", n), _text("統一編號 ", n), _text("passport ", n), _text("no ", n, "0")
    )


def phone_text() -> Column:
    n = _digits8(F.col("o_orderkey"))
    return _branches(
        6,
        _text("電話:09", n),
        _text("電話09", n),
        _text("order tel +886-9", F.substring(n, 7, 2), "-345-678"),
        _text("訂單 (02)", F.substring(n, 5, 4), "-6789"),
        _text("免付費 0800-123-", F.substring(n, 6, 3)),
        _text("09", n, "="),
    )


def id_text() -> Column:
    key = F.col("o_orderkey")
    letter = F.char((key % 26 + 65).cast("int"))
    return _text("ID ", letter, (key % 2 + 1).cast("string"), _digits8(key * 7919), ".")


def card_text() -> Column:
    key = F.col("o_orderkey")
    first = F.lpad((key % 10000).cast("string"), 4, "0")
    last = F.lpad((key * 7 % 10000).cast("string"), 4, "0")
    return _text("pay ", first, "-1111-2222-", last, " ok")


def email_text() -> Column:
    key = F.col("o_orderkey").cast("string")
    return _branches(
        3,
        _text("to user", key, "@example.com."),
        _text("信箱user", key, "@example.com"),
        _text("信箱u.", key, "@example.com"),
    )


def address_text() -> Column:
    number = (F.col("o_orderkey") % 1000 + 1).cast("string")
    return _text("地址：台北市中正區重慶南路", number, "號3樓之2，完")


TEMPLATES = {
    "NHI_NUMBER": nhi_text,
    "PASSPORT_NUMBER": passport_text,
    "PHONE_NUMBER": phone_text,
    "TAIWAN_ID_CARD": id_text,
    "CREDIT_CARD": card_text,
    "EMAIL": email_text,
    "ADDRESS": address_text,
}


def template_source(pii_type: str):
    def source(spark, sf_dir):
        orders = order_keys(spark, sf_dir)
        return orders.select(F.col("o_orderkey").alias("doc_id"), TEMPLATES[pii_type]().alias("text"))

    return source


def template_query(pii_type: str) -> Query:
    return detector_query(template_source(pii_type), pii_type)


def _all_templates_text() -> Column:
    return F.concat_ws("\n", *[F.coalesce(build(), F.lit("")) for build in TEMPLATES.values()])


def all_templates(spark, sf_dir):
    """All seven template texts of a key in one text, scanned by all detectors."""
    orders = order_keys(spark, sf_dir)
    texts = orders.select(F.col("o_orderkey").alias("doc_id"), _all_templates_text().alias("text"))
    return scan(texts, keep=["doc_id"])


# ---- Checksums, offsets, contexts ----------------------------------------------------------------------


def luhn_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    number = F.concat(F.lit("4"), F.lpad((key * 104729).cast("string"), 14, "0"), (key % 10).cast("string"))
    orders = order_keys(spark, sf_dir)
    return orders.select("o_orderkey", number.alias("number"), luhn_valid(number).alias("valid"))


def national_id_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    number = F.concat(
        F.char((key % 26 + 65).cast("int")), (key % 3 + 1).cast("string"), _digits8(key * 7919)
    )
    orders = order_keys(spark, sf_dir)
    return orders.select("o_orderkey", number.alias("number"), national_id_valid(number).alias("valid"))


def digit_offsets(spark, sf_dir):
    matches = find_matches(F.col("text"), "[0-9]+")
    return documents(spark, sf_dir).select("doc_id", F.inline(matches).alias("value", "start_pos"))


def digit_contexts(spark, sf_dir):
    text = F.col("text")
    rows = F.transform(
        find_matches(text, "[0-9]+"),
        lambda m: F.struct(
            m["start"].alias("start_pos"),
            context_window(text, m["start"], F.length(m["value"]), 10).alias("context"),
        ),
    )
    return documents(spark, sf_dir).select("doc_id", F.inline_outer(rows)).where("context IS NOT NULL")


# ---- Own detectors -------------------------------------------------------------------------------------

HEX_RULE = RuleDetector(
    name="HexScanner",
    pii_type="HEX",
    pattern="[0-9a-f]{8,}",
    window=20,
    score=0.5,
    positive=["The", "###"],
    negative=["and", "de "],
    ignore_case=True,
)


def own_rule(spark, sf_dir):
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=[HEX_RULE])


def find_long_numbers(text: str) -> Iterator[dict]:
    for match in re.finditer("[0-9]{6,}", text):
        yield {"matched_value": match.group(), "confidence_score": 0.3, "start_pos": match.start()}


def own_python_function(spark, sf_dir):
    detector = PythonDetector(name="LongNumberScanner", pii_type="LONG_NUMBER", scan=find_long_numbers)
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=[detector])


GROUP_RULE = RuleDetector(
    name="GroupScanner", pii_type="LETTERS", pattern="[0-9]([a-z]+)[0-9]", group=1, window=10, score=0.5
)


def own_group(spark, sf_dir):
    """A rule whose group ends before the match does."""
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=[GROUP_RULE])


def find_by_suffix(text: str, row: dict) -> Iterator[dict]:
    for finding in find_long_numbers(text):
        yield finding | {"confidence_score": 0.9 if row["path"].endswith(".csv") else 0.3}


def own_python_context(spark, sf_dir):
    """A Python function that scores by the suffix of the file's path."""
    detector = PythonDetector(
        name="LongNumberScanner", pii_type="LONG_NUMBER", scan=find_by_suffix, columns=["path"]
    )
    files = documents(spark, sf_dir).withColumn("path", _file_path())
    return scan(files, keep=["doc_id"], detectors=[detector])


def find_or_fail(text: str, row: dict) -> list[dict]:
    if row["doc_id"] % 7 == 3:
        raise ValueError("this text cannot be scanned")
    return list(find_long_numbers(text))


def own_python_failing(spark, sf_dir):
    """A Python function that raises for some texts, beside a rule that does not."""
    detector = PythonDetector(
        name="LongNumberScanner", pii_type="LONG_NUMBER", scan=find_or_fail, columns=["doc_id"]
    )
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=[detector, HEX_RULE])


# ---- Report --------------------------------------------------------------------------------------------


def _template_findings(spark, sf_dir):
    found = all_templates(spark, sf_dir)
    return found.withColumn("file_path", F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")))


def report(spark, sf_dir):
    return to_report(_template_findings(spark, sf_dir))


def risk_tiers(spark, sf_dir):
    tier = risk_tier(F.col("confidence_score")).alias("tier")
    return _template_findings(spark, sf_dir).groupBy("pii_type", tier).agg(F.count("*").alias("findings"))


def masked(spark, sf_dir):
    return _template_findings(spark, sf_dir).select(
        "doc_id", "start_pos", "pii_type", mask_value(F.col("matched_value")).alias("masked")
    )


def finding_counts(spark, sf_dir):
    return count_findings(_template_findings(spark, sf_dir))


def validation_labels(spark, sf_dir):
    label = validation_label(F.col("validation_status")).alias("label")
    return _template_findings(spark, sf_dir).groupBy("pii_type", label).agg(F.count("*").alias("findings"))


# ---- Names ---------------------------------------------------------------------------------------------


def chunks(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk", "chunk_text")
    )


def _event_entities(spark, sf_dir):
    """Entities written from events: two overlapping chunks per document and ten entities to a chunk.

    Even keys touch the next entity, odd ones leave a gap, and some words are empty once cleaned.
    """
    key = F.col("event_id")
    idx = (key % 10).cast("int")
    chunk = (F.floor(key / 10) % 2).cast("int")
    start = idx * 4 + F.when(chunk == 0, F.lit(CHUNK_STEP)).otherwise(F.lit(0))
    word = F.concat(F.lit("##"), F.substring(F.lit("a bc"), F.lit(1), idx % 4 + 1))
    return table(spark, sf_dir, "events", "event_id").select(
        F.floor(key / 20).alias("doc_id"),
        chunk.alias("chunk"),
        idx.alias("idx"),
        F.when(F.floor(key / 3) % 3 == 0, F.lit("ORG")).otherwise(F.lit("PERSON")).alias("entity_group"),
        F.when(key % 11 == 0, F.lit(" ##")).otherwise(word).alias("word"),
        start.alias("start"),
        (start + F.when(key % 2 == 0, F.lit(4)).otherwise(F.lit(3))).alias("end"),
        (key * 37 % 101 / F.lit(100.0)).alias("score"),
    )


ENTITY = ["entity_group", "word", "start", "end", "score"]


def _in_order(rows: Column) -> Column:
    """Entities in the order of their number within the chunk."""
    return F.transform(F.sort_array(rows), lambda e: F.struct(*[e[name].alias(name) for name in ENTITY]))


def entity_runs(spark, sf_dir):
    """Touching entities of a chunk joined. A chunk has ten entities here, and never over 500."""
    per_chunk = _event_entities(spark, sf_dir).groupBy("doc_id", "chunk")
    entities = per_chunk.agg(F.collect_list(F.struct("idx", *ENTITY)).alias("rows"))
    runs = merge_touching(clean_entities(_in_order(F.col("rows"))))
    return entities.select("doc_id", "chunk", F.inline(runs))


def entity_places(spark, sf_dir):
    """Person names of a document with document offsets, each word and place once."""
    per_document = _event_entities(spark, sf_dir).groupBy("doc_id")
    entities = per_document.agg(F.collect_list(F.struct("idx", "chunk", *ENTITY)).alias("rows"))
    first = _in_order(F.filter("rows", lambda e: e["chunk"] == 0))
    second = _in_order(F.filter("rows", lambda e: e["chunk"] == 1))
    places = locate_entities(F.array(first, second))
    return entities.select("doc_id", F.inline(places)).select("doc_id", "start", "word", "chunk", "score")


def capitalised_words():
    """A predictor that SQL can follow: every capitalised word is a person."""

    def predict(texts: list[str]) -> list[list[dict]]:
        return [
            [
                {
                    "entity_group": "PERSON",
                    "word": m.group(),
                    "start": m.start(),
                    "end": m.end(),
                    "score": min(len(m.group()), 20) / 20,
                }
                for m in re.finditer("[A-Z][A-Za-z]*", text)
            ]
            for text in texts
        ]

    return predict


def names(spark, sf_dir):
    detector = NameDetector(predictor_factory=capitalised_words)
    return scan(documents(spark, sf_dir), keep=["doc_id"], detectors=[detector])


# ---- Files ---------------------------------------------------------------------------------------------

FILE_NAMES = [
    "a.txt", "B.HTML", ".env", "notes.what", "plain", "e.csv", "f.docx", "g.xlsx", "h.pdf", "i.bin", "j.tar.gz", "k.x/l",
]


def _file_path() -> Column:
    names = F.array(*[F.lit(n) for n in FILE_NAMES])
    return F.concat(
        F.lit("/in/"), "doc_id", F.lit("/"), F.get(names, (F.col("doc_id") % len(FILE_NAMES)).cast("int"))
    )


def extensions(spark, sf_dir):
    path = _file_path()
    return table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", path.alias("path"), extension(path).alias("extension"), route_by_extension(path).alias("route")
    )


def _text_files(spark, sf_dir):
    """Documents as text files with CRLF line ends."""
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return _as_files(documents(spark, sf_dir), F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")), crlf)


def _as_files(df: DataFrame, path: Column, content: Column) -> DataFrame:
    content = content.cast("binary")
    return df.select(
        path.alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content")
    )


def _mixed_files(spark, sf_dir):
    """Documents as files of every kind: by known suffix, by content, empty, broken and unsupported."""
    kind = F.col("doc_id") % len(FILE_NAMES)
    text = F.col("text").cast("binary")
    content = (
        F.when(kind == 5, F.lit(b""))
        .when(kind == 8, F.concat(F.lit(b"%PDF-1.7 "), text))
        .when(kind == 9, F.concat(F.lit(b"\x00\x01"), text))
        .when(kind == 10, F.concat(F.lit(b"PK\x03\x04"), text))
        .otherwise(text)
    )
    return _as_files(documents(spark, sf_dir), _file_path(), content)


def _mixed_documents(spark, sf_dir):
    return extract_text(_mixed_files(spark, sf_dir))


def file_status(spark, sf_dir):
    return _mixed_documents(spark, sf_dir).select(
        "doc_id", "file_path", "mime_type", "file_size_bytes", "status",
        status_label(F.col("status")).alias("status_label"), "failed", "error_message",
        F.length("text").alias("text_length"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def _with_broken_reads(files: DataFrame) -> DataFrame:
    """Files whose key ends in 7 could not be opened; of the others, those in 3 broke off while read."""
    key = F.split("path", "/")[2].cast("bigint")
    unreadable = key % 10 == 7
    broken = unreadable | (key % 10 == 3)
    return files.select(
        "path",
        "length",
        F.when(~broken, F.col("content")).alias("content"),
        F.when(broken, F.concat(F.lit("cannot read "), "path")).alias("read_error"),
        unreadable.alias("unreadable"),
    )


def read_errors(spark, sf_dir):
    documents = extract_text(_with_broken_reads(_mixed_files(spark, sf_dir)))
    return documents.select("doc_id", "mime_type", "file_size_bytes", "status", "failed", "error_message")


def failed_files(spark, sf_dir):
    return count_failed(extract_text(_with_broken_reads(_mixed_files(spark, sf_dir))))


def files_scanned(spark, sf_dir):
    """From file content to findings, over every document as a text file."""
    return findings_of(scan_documents(extract_text(_text_files(spark, sf_dir)))).drop("timestamp_utc")


def only_completed_files(spark, sf_dir):
    """Findings per file over files of every kind: only those with text can have any."""
    scanned = scan_documents(_mixed_documents(spark, sf_dir))
    return scanned.select("doc_id", "status", F.size("findings").alias("findings"))


def report_gate(spark, sf_dir):
    """Totals over files of every kind, some of which could not be read, and whether a report is due."""
    documents = extract_text(_with_broken_reads(_mixed_files(spark, sf_dir)))
    return scan_totals(scan_documents(documents))


def report_not_due(spark, sf_dir):
    """Totals where no finding makes up for the files that failed."""
    documents = extract_text(_with_broken_reads(_mixed_files(spark, sf_dir)))
    return scan_totals(scan_documents(documents, ["NoSuchScanner"]))


def legacy_text(spark, sf_dir):
    """Text files that only one of the three legacy encodings fits, after those tried before it."""
    key = F.col("o_orderkey")
    digits = key.cast("string").cast("binary")
    prefix = _branches(3, F.lit("電話 ".encode("big5")), F.lit("丂 ".encode("gbk")), F.lit("é".encode("latin-1")))
    path = F.concat(F.lit("/in/"), key, F.lit(".txt"))
    orders = order_keys(spark, sf_dir)
    return extract_text(_as_files(orders, path, F.concat(prefix, digits))).select("doc_id", "status", "text")


WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_NS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _package(parts: dict[str, str]) -> bytes:
    buffer = BytesIO()
    with ZipFile(buffer, "w") as package:
        for name, content in parts.items():
            package.writestr(name, content)
    return buffer.getvalue()


def _relation(name: str, kind: str, target: str) -> str:
    return (
        f'<Relationships xmlns="{PACKAGE_NS}"><Relationship Id="{name}" '
        f'Type="{RELATIONS_NS}/{kind}" Target="{target}"/></Relationships>'
    )


@F.arrow_udf(T.BinaryType())
def word_file(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """A Word document with a paragraph per line, a table with the key, and a header."""

    def paragraph(text: str) -> str:
        return f"<w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    def build(key: int, text: str) -> bytes:
        lines = "".join(map(paragraph, text.split("\n")))
        cells = f"<w:tbl><w:tr><w:tc>{paragraph(f'key {key}')}</w:tc><w:tc>{paragraph('')}</w:tc></w:tr></w:tbl>"
        section = '<w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr>'
        names = f'xmlns:w="{WORD_NS}" xmlns:r="{RELATIONS_NS}"'
        return _package(
            {
                "word/document.xml": f"<w:document {names}><w:body>{cells}{lines}{section}</w:body></w:document>",
                "word/_rels/document.xml.rels": _relation("h", "header", "header1.xml"),
                "word/header1.xml": f"<w:hdr {names}>{paragraph(f'header {key}')}</w:hdr>",
            }
        )

    rows = zip(ids.to_pylist(), texts.to_pylist(), strict=True)
    return pa.array([build(*row) for row in rows], pa.binary())


@F.arrow_udf(T.BinaryType())
def workbook_file(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """A workbook with a row per line: its number and its text."""

    def build(key: int, text: str) -> bytes:
        rows = "".join(
            f'<row><c><v>{i}</v></c><c t="inlineStr"><is><t>{escape(line)}</t></is></c></row>'
            for i, line in enumerate(text.split("\n"), 1)
            if line
        )
        sheet = f'<sheet name={quoteattr(f"key {key}")} sheetId="1" r:id="s"/>'
        return _package(
            {
                "xl/workbook.xml": f'<workbook xmlns="{SHEET_NS}" xmlns:r="{RELATIONS_NS}"><sheets>{sheet}</sheets></workbook>',
                "xl/_rels/workbook.xml.rels": _relation("s", "worksheet", "worksheets/sheet1.xml"),
                "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET_NS}"><sheetData>{rows}</sheetData></worksheet>',
            }
        )

    rows = zip(ids.to_pylist(), texts.to_pylist(), strict=True)
    return pa.array([build(*row) for row in rows], pa.binary())


def office_query(suffix: str, build) -> Query:
    def query(spark, sf_dir):
        files = _as_files(
            documents(spark, sf_dir),
            F.concat(F.lit("/in/"), "doc_id", F.lit(suffix)),
            build("doc_id", "text"),
        )
        return extract_text(files).select(
            "doc_id", "mime_type", "status", "error_message",
            F.length("text").alias("text_length"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
        )

    return query


def folder_listing(spark, sf_dir):
    """The table files themselves, listed as a folder."""
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return list_files(spark, sf_dir).select(name, "length")


def folder_status(spark, sf_dir):
    """The table files as scan input: none of them is a type that holds text."""
    status = extract_text(read_files(spark, sf_dir))
    name = F.element_at(F.split("file_path", "/"), -1).alias("name")
    return status.select(name, "mime_type", "file_size_bytes", "status", "failed", "error_message")


# ---- Registry ------------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    "cards_documents": detector_query(documents, "CREDIT_CARD"),
    "cards_pages": detector_query(pages, "CREDIT_CARD"),
    "emails_documents": detector_query(documents, "EMAIL"),
    "emails_pages": detector_query(pages, "EMAIL"),
    "passports_documents": detector_query(documents, "PASSPORT_NUMBER"),
    "passports_pages": detector_query(pages, "PASSPORT_NUMBER"),
    "nhi_documents": detector_query(documents, "NHI_NUMBER"),
    "nhi_pages": detector_query(pages, "NHI_NUMBER"),
    "scan_all_documents": detector_query(documents),
    "scan_documents_in_segments": scan_documents_in_segments,
    "scan_all_pages": detector_query(pages),
    "scan_subset": scan_subset,
    "nhi_template": template_query("NHI_NUMBER"),
    "passports_template": template_query("PASSPORT_NUMBER"),
    "phones_template": template_query("PHONE_NUMBER"),
    "ids_template": template_query("TAIWAN_ID_CARD"),
    "cards_template": template_query("CREDIT_CARD"),
    "emails_template": template_query("EMAIL"),
    "address_template": template_query("ADDRESS"),
    "scan_all_templates": all_templates,
    "luhn_flags": luhn_flags,
    "national_id_flags": national_id_flags,
    "digit_offsets": digit_offsets,
    "digit_contexts": digit_contexts,
    "own_rule": own_rule,
    "own_python_function": own_python_function,
    "own_group": own_group,
    "own_python_context": own_python_context,
    "own_python_failing": own_python_failing,
    "report": report,
    "risk_tiers": risk_tiers,
    "masked": masked,
    "finding_counts": finding_counts,
    "validation_labels": validation_labels,
    "chunks": chunks,
    "entity_runs": entity_runs,
    "entity_places": entity_places,
    "names": names,
    "extensions": extensions,
    "file_status": file_status,
    "read_errors": read_errors,
    "failed_files": failed_files,
    "files_scanned": files_scanned,
    "only_completed_files": only_completed_files,
    "report_gate": report_gate,
    "report_not_due": report_not_due,
    "legacy_text": legacy_text,
    "word_files": office_query(".docx", word_file),
    "workbook_files": office_query(".xlsx", workbook_file),
    "folder_listing": folder_listing,
    "folder_status": folder_status,
}
