"""Listing, routing, decoding and extraction of files in a folder."""

import errno
import os

import office_files as office
import pytest
from pyspark.sql import functions as F

from piisieve import extract_text, list_files, read_files
from piisieve.schema import DOCUMENT_SCHEMA
from piisieve.sources import listing
from piisieve.sources.extract import extension, sniff_mime
from piisieve.sources.routing import HEAD_BYTES, mime_of_head, suffix_of

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

MERGED = office.table(
    [office.cell("a", '<w:gridSpan w:val="2"/>'), office.cell("b", '<w:vMerge w:val="restart"/>')],
    [office.cell("c"), office.cell("d"), office.cell("", "<w:vMerge/>")],
)
DOCX = office.docx(
    office.table([office.cell("in table")])
    + office.paragraph("first")
    + office.paragraph("")
    + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>"
    + "<w:pPr>" + office.section('<w:headerReference w:type="default" r:id="h1"/>') + "</w:pPr></w:p>"
    + MERGED
    + office.section('<w:footerReference w:type="default" r:id="f1"/>'),
    {"h1": ("header", office.paragraph("top")), "f1": ("footer", office.paragraph("bottom"))},
)
DOCX_TEXT = "first\nx\ty\nlink\nin table\na\na\nb\nc\nd\nb\ntop\ntop\nbottom"
XLSX = office.xlsx(
    {
        "One": [
            ['<c t="s"><v>0</v></c>', "<c><v>42</v></c>", "<c/>", "<c><v>0.5</v></c>"],
            ["<c/>"],
            ['<c t="b"><v>1</v></c>', '<c t="e"><v>#N/A</v></c>', '<c t="inlineStr"><is><t>in</t></is></c>'],
        ],
        "Two & 2": [['<c s="1"><v>45292</v></c>', '<c s="1"><v>45292.75</v></c>', '<c s="2"><v>0.25</v></c>', '<c t="str"><v>f</v></c>']],
    },
    shared=["文字 text"],
    formats='<numFmts><numFmt numFmtId="164" formatCode="hh:mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs>',
)
XLSX_TEXT = (
    "\n--- Sheet: One ---\n\n文字 text 42 0.5\nTrue #N/A in\n"
    "\n--- Sheet: Two & 2 ---\n\n2024-01-01 00:00:00 2024-01-01 18:00:00 06:00:00 f"
)

# name: content, status, mime, text
FILES = {
    "a.txt": ("中文 café".encode(), "COMPLETED", "text/plain", "中文 café"),
    "B.TXT": (b"upper", "COMPLETED", "text/plain", "upper"),
    "big5.txt": ("中文".encode("big5"), "COMPLETED", "text/plain", "中文"),
    "gbk.md": ("简体".encode("gbk"), "COMPLETED", "text/plain", None),
    "latin.csv": (b"caf\xe9", "COMPLETED", "text/plain", "café"),
    "crlf.log": (b"a\r\nb\rc\n", "COMPLETED", "text/plain", "a\nb\nc\n"),
    "bom.json": (b"\xef\xbb\xbf{}", "COMPLETED", "text/plain", "﻿{}"),
    "page.html": (b"<b>a@b.com</b>", "COMPLETED", "text/plain", "<b>a@b.com</b>"),
    "empty.txt": (b"", "SKIPPED", "", None),
    ".env": (b"hidden", "COMPLETED", "text/plain", "hidden"),
    "_x.log": (b"underscore", "COMPLETED", "text/plain", "underscore"),
    "sub/.git/deep.ini": (b"deep", "COMPLETED", "text/plain", "deep"),
    "notes.unknown": ("文字 text\n".encode(), "COMPLETED", "text/plain", "文字 text\n"),
    "random.bin": (b"\x00\x01\x02\xff", "SKIPPED", "application/octet-stream", None),
    "archive.zip": (b"PK\x03\x04....", "SKIPPED", "application/zip", None),
    "ok.docx": (DOCX, "COMPLETED", DOCX_MIME, DOCX_TEXT),
    "by_content_docx": (DOCX, "COMPLETED", DOCX_MIME, DOCX_TEXT),
    "broken.docx": (b"no zip", "ERROR", DOCX_MIME, None),
    "ok.xlsx": (XLSX, "COMPLETED", XLSX_MIME, XLSX_TEXT),
    "broken.xlsx": (b"no zip", "SKIPPED", XLSX_MIME, None),
    "a.pdf": (b"%PDF-1.4", "SKIPPED", "application/pdf", None),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, (content, *_) in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def documents(spark, folder):
    df = extract_text(read_files(spark, folder, partitions=4))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in DOCUMENT_SCHEMA]
    return {os.path.relpath(r.file_path, folder): r for r in df.collect()}


def test_every_file_is_listed_once(spark, folder):
    rows = list_files(spark, folder).collect()
    assert sorted(os.path.relpath(r.path, folder) for r in rows) == sorted(FILES)
    assert {r.length for r in rows} == {len(c) for c, *_ in FILES.values()}


def test_one_file_is_its_own_listing(spark, folder):
    path = os.path.join(folder, ".env")
    assert [r.path for r in list_files(spark, path).collect()] == [path]


def test_missing_path_is_an_error(spark, folder):
    with pytest.raises(Exception, match="no such file"):
        list_files(spark, folder + "/none").collect()


def test_more_folders_than_partitions(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"d{i}" / "x").mkdir(parents=True)
        (tmp_path / f"d{i}" / "x" / "f.txt").write_text("t")
        (tmp_path / f"d{i}" / "g.txt").write_text("t")
    assert list_files(spark, str(tmp_path)).select("path").distinct().count() == 140


@pytest.mark.parametrize("name", FILES)
def test_status_and_text(documents, name):
    content, status, mime, text = FILES[name]
    row = documents[name]
    assert (row.status, row.mime_type, row.file_size_bytes) == (status, mime, len(content))
    assert row.failed is False
    if text is not None or status != "COMPLETED":
        assert row.text == text


def test_cascade_takes_the_first_encoding_that_fits(documents):
    content = FILES["gbk.md"][0]
    expected = None
    for encoding in ("utf-8", "big5", "gbk", "latin-1"):
        try:
            expected = content.decode(encoding)
            break
        except UnicodeDecodeError:
            pass
    assert documents["gbk.md"].text == expected


def test_messages(documents):
    assert documents["empty.txt"].error_message == "空檔案"
    assert documents["random.bin"].error_message == "不支援的檔案類型"
    assert documents["broken.xlsx"].error_message == "檔案可能已加密或已損毀，無法解析。"
    assert documents["broken.docx"].error_message.startswith("解析 DOCX 檔案時發生錯誤: ")
    assert documents["a.txt"].error_message is None


def test_pdf_with_an_extractor(spark, folder):
    def extractor(content):
        if b"1.4" not in content:
            raise ValueError("bad")
        return "from pdf a@b.com"

    df = extract_text(read_files(spark, folder + "/a.pdf"), extractor)
    assert [(r.status, r.text) for r in df.collect()] == [("COMPLETED", "from pdf a@b.com")]


def test_unreadable_and_broken_reads(spark):
    df = spark.createDataFrame(
        [
            ("/gone.txt", 3, None, "gone", True),
            ("/io.txt", 3, None, "io error", False),
            ("/io.what", 3, None, "io error", False),
        ],
        "path string, length bigint, content binary, read_error string, unreadable boolean",
    )
    rows = {r.doc_id: (r.status, r.failed, r.error_message, r.mime_type) for r in extract_text(df).collect()}
    assert rows["/gone.txt"] == ("ERROR", False, "gone", "")
    assert rows["/io.txt"] == ("ERROR", False, "io error", "text/plain")
    assert rows["/io.what"][:3] == ("ERROR", True, "io error")


def test_files_from_the_binary_reader(spark, folder):
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = {r.file_path.rsplit("/", 1)[1]: r.text for r in extract_text(df).collect()}
    assert rows["a.txt"] == "中文 café"
    assert ".env" not in rows


@pytest.mark.parametrize(
    "path,expected",
    [
        ("/x/a.TXT", ".txt"), ("/x/a.tar.gz", ".gz"), ("/x/.env", ""), ("/dir.x/file", ""),
        ("/x/a.", ""), ("/x/..txt", ".txt"), ("/x/.a.md", ".md"), ("/x/a.b c", ".b c"),
    ],
)
def test_extension(spark, path, expected):
    assert spark.range(1).select(extension(F.lit(path)).alias("e")).first().e == expected


def test_sniff_wide_text(spark):
    row = spark.range(1).select(sniff_mime(F.lit(b"\xff\xfea\x00")).alias("m")).first()
    assert row.m == "text/plain"


def rows_in_process(path, folders=16):
    """The listing as the tasks give it, run here so that faults of the system can be put in their way."""
    reader = listing.FileListingReader(str(path), folders)
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


def scandir_with(fault, bad):
    def scandir(path, real=os.scandir):
        if os.path.basename(path) == bad:
            raise fault
        return real(path)

    return scandir


def test_folder_without_permission_keeps_a_row(tmp_path, monkeypatch):
    (tmp_path / "shut" / "in").mkdir(parents=True)
    (tmp_path / "f.txt").write_text("t")
    monkeypatch.setattr(listing.os, "scandir", scandir_with(PermissionError(errno.EACCES, "no"), b"shut"))
    for folders in (1, 16):
        rows = {os.path.relpath(r["path"], tmp_path): r["read_error"] for r in rows_in_process(tmp_path, folders)}
        assert rows == {"f.txt": None, "shut": "沒有足夠的權限讀取檔案"}


@pytest.mark.parametrize("folders", [1, 16])
def test_fault_of_the_storage_is_raised(tmp_path, monkeypatch, folders):
    (tmp_path / "a" / "b").mkdir(parents=True)
    monkeypatch.setattr(listing.os, "scandir", scandir_with(OSError(errno.EIO, "input/output error"), b"a"))
    with pytest.raises(OSError, match="input/output"):
        rows_in_process(tmp_path, folders)


def test_many_folders_in_few_partitions(tmp_path):
    for i in range(3000):
        (tmp_path / f"d{i}").mkdir()
    (tmp_path / "d7" / "x").write_text("t")
    assert len(listing.FileListingReader(str(tmp_path), 16).partitions()) == 16
    assert [os.path.basename(r["path"]) for r in rows_in_process(tmp_path)] == ["x"]


def test_names_of_any_bytes_relative_paths_and_broken_links(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    name = os.fsencode(tmp_path / "in") + "/文件.txt".encode("big5")
    with open(name, "wb") as file:
        file.write(b"mail a@b.com")
    os.symlink("nowhere", tmp_path / "in" / "link.txt")
    os.symlink("loop.txt", tmp_path / "in" / "loop.txt")
    monkeypatch.chdir(tmp_path)
    files = read_files(spark, "in", partitions=2)
    monkeypatch.chdir("/")
    rows = {os.path.relpath(r.file_path, tmp_path): (r.status, r.text or r.error_message) for r in extract_text(files).collect()}
    assert rows == {
        "in/" + "文件.txt".encode("big5").decode("utf-8", "backslashreplace"): ("COMPLETED", "mail a@b.com"),
        "in/link.txt": ("ERROR", "路徑不是一個有效的檔案"),
        "in/loop.txt": ("ERROR", "路徑不是一個有效的檔案"),
    }


def test_only_the_head_of_skipped_files_is_read(spark, tmp_path):
    size = HEAD_BYTES + 5000
    (tmp_path / "a.bin").write_bytes(b"\x00\xff" * (size // 2))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + b" " * size)
    (tmp_path / "c").write_bytes(b"%PDF-" + b" " * size)
    (tmp_path / "d").write_bytes(b"t" * size + b"\x00")
    files = read_files(spark, str(tmp_path), skip_pdf=True)
    sizes = {os.path.basename(r.path): len(r.content) for r in files.select("path", "content").collect()}
    assert sizes == {"a.bin": HEAD_BYTES, "b.pdf": HEAD_BYTES, "c": HEAD_BYTES, "d": size + 1}
    found = {os.path.basename(r.file_path): (r.status, r.file_size_bytes) for r in extract_text(files).collect()}
    assert found == {"a.bin": ("SKIPPED", size), "b.pdf": ("SKIPPED", size + 5), "c": ("SKIPPED", size + 5), "d": ("COMPLETED", size + 1)}
    whole = read_files(spark, str(tmp_path)).select("path", "content").collect()
    assert {os.path.basename(r.path): len(r.content) for r in whole}["c"] == size + 5


def test_both_ways_to_tell_a_type_agree(spark, documents):
    heads = [content for content, *_ in FILES.values()] + [b"\xff\xfea\x00", b"PK\x03\x04xl/", b"a\x1b[0m", b"a\x1fb", b"\x7f"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    assert [r.m for r in df.select(sniff_mime(F.col("c")).alias("m")).collect()] == [mime_of_head(h) for h in heads]
    paths = list(FILES) + ["/x/.env", "/dir.x/file", "/x/a.", "/x/..txt", "/x/a.b c", "/x/a.TXT"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.e for r in df.select(extension(F.col("p")).alias("e")).collect()] == [suffix_of(p) for p in paths]


def test_stores_give_the_same_rows(spark, tmp_path):
    """A plain path, `file:` and a pyarrow file system that is no mount list the same files, hidden and empty ones too."""
    import pyarrow.fs as pafs

    for name, body in {"a/.hidden": b"x@y.com", "a/_under": b"u", "a/b/empty.txt": b"", "a/b/c/d.txt": b"deep", "top.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    base = str(tmp_path)

    def rows(df, prefix):
        return sorted((r.path.removeprefix(prefix).lstrip("/"), r.length, bytes(r.content), r.read_error) for r in df.collect())

    plain = rows(read_files(spark, base, partitions=3), base)
    assert [r[0] for r in plain] == ["a/.hidden", "a/_under", "a/b/c/d.txt", "a/b/empty.txt", "top.txt"]
    assert rows(read_files(spark, f"file://{base}", partitions=3), base) == plain
    store = pafs.SubTreeFileSystem(base, pafs.LocalFileSystem())
    assert rows(read_files(spark, "", partitions=3, filesystem=store), "") == plain
    listed = list_files(spark, "a", filesystem=store).collect()
    assert sorted(r.path for r in listed) == ["a/.hidden", "a/_under", "a/b/c/d.txt", "a/b/empty.txt"]
    with pytest.raises(Exception):
        read_files(spark, "nosuchscheme://bucket/folder")


def test_reads_are_dealt_by_bytes(spark, tmp_path):
    """A folder of one large file and many small ones: no task gets more than twice its share, unless one file does."""
    (tmp_path / "big.txt").write_bytes(b"x" * 400_000)
    for i in range(300):
        (tmp_path / f"s{i:03}.txt").write_bytes(b"y" * 1000)
    files = list_files(spark, str(tmp_path))
    dealt = listing.dealt_by_bytes(files, 8)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("b"), F.count("*").alias("n")).collect()
    share = 700_000 / 8
    assert sum(r.n for r in sizes) == 301
    assert all(r.b <= 2 * share or r.b <= 400_000 + share for r in sizes), sizes
    small_tasks = [r for r in sizes if r.b < 400_000]
    assert len(small_tasks) >= 3 and max(r.b for r in small_tasks) <= 2 * share, sizes


def test_conditions_on_path_and_length_are_applied_by_the_listing(spark, tmp_path):
    for name, body in {"a.txt": b"aaaa", "b.txt": b"", "c.csv": b"cccccc", "d/e.txt": b"eeeeeeee"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    condition = F.col("path").endswith(".txt") & (F.col("length") > 3)
    listed = list_files(spark, str(tmp_path)).where(condition)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan, plan  # no filter node: both parts are taken by the source
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listed.collect()) == ["a.txt", "e.txt"]
    read = read_files(spark, str(tmp_path), partitions=2, where=condition & F.col("path").contains("/d/"))
    assert [(r.path.rsplit("/", 1)[-1], bytes(r.content)) for r in read.collect()] == [("e.txt", b"eeeeeeee")]
    mixed = list_files(spark, str(tmp_path)).where(F.col("path").endswith(".csv") | (F.col("length") == 0))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in mixed.collect()) == ["b.txt", "c.csv"]
