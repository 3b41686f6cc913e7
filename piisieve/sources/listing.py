"""Every file under a folder, as a DataFrame, with hidden and empty files included.

Spark's own file readers leave out names that begin with `.` or `_` and empty files, and keep the whole
listing on the driver. Here the driver only descends until there are enough folders to share out; the
executors list those and read the files. The folder must be a path that all of them can see.

Nothing is lost without a row: a folder or file that may not be read, or that has gone since it was listed,
gives a row with `read_error`. Any other fault while listing is raised, so that Spark tries the task again.

A plain path, or one with `file:`, is listed with the operating system, names of any bytes included. Any other store
is listed and read through a `pyarrow.fs` file system, given as `filesystem` or found from the URI (S3, GCS, HDFS, ...);
it lists hidden and empty files like any other, so every store gives the same rows.
"""

import base64
import errno
import os
import pickle
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from .routing import HEAD_BYTES, is_routed
from .tables import TASKS_PER_CORE

# `raw_path` has the bytes of the name and opens the file; `path` shows bytes that are no UTF-8 as \xNN.
LISTING_DDL = "path string, modificationTime timestamp, length bigint, raw_path binary, read_error string"
FILE_DDL = (
    "path string, modificationTime timestamp, length bigint, content binary, "
    "read_error string, unreadable boolean"
)
ROWS_PER_BATCH = 4096
# Content is handed on in batches of about this many bytes, so memory follows the largest file.
BYTES_PER_BATCH = 32 * 1024 * 1024
# Content that one task reads, where the number of tasks is not given.
BYTES_PER_TASK = 128 * 1024 * 1024
# A row holds less than 2 GiB; a larger file that would be read whole is reported as an error rather than cut.
LARGEST_FILE = 2**31 - 2**20

# Messages of the check before a file is read.
NO_FILE = "路徑不是一個有效的檔案"
NO_PERMISSION = "沒有足夠的權限讀取檔案"


def _message(error: OSError) -> str | None:
    """The message of a file or folder that cannot be read; None for faults that may pass."""
    if error.errno in (errno.ENOENT, errno.ENOTDIR, errno.EISDIR, errno.ELOOP, errno.ENAMETOOLONG):
        return NO_FILE
    return NO_PERMISSION if isinstance(error, PermissionError) else None


@dataclass
class FolderPartition(InputPartition):
    """Folders, or one file, that one task lists; `recursive` says for each whether its subfolders are included."""

    folders: list[tuple[bytes, bool]]


class FileListing(DataSource):
    """Paths, times and sizes of all files under `path`; a single file lists itself."""

    @classmethod
    def name(cls) -> str:
        return "piisieve_listing"

    def schema(self) -> str:
        return LISTING_DDL

    def reader(self, schema) -> "FileListingReader":
        store = self.options.get("filesystem")
        filesystem = pickle.loads(base64.b64decode(store)) if store else None
        return FileListingReader(self.options["path"], int(self.options.get("folders", "64")), filesystem)


def store_of(path: str, filesystem: pafs.FileSystem | None = None) -> tuple[pafs.FileSystem | None, str]:
    """The pyarrow file system of a path and the path in it; none for a plain or `file:` path, which the OS lists.

    A URI of a scheme that pyarrow cannot open raises: pass a `filesystem` for it (for instance
    `pyarrow.fs.PyFileSystem(pyarrow.fs.FSSpecHandler(...))` over any fsspec store).
    """
    if filesystem is not None:
        return filesystem, path
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return None, local_path(path)


# Conditions on listing rows that the source applies itself, exactly as Spark would: on `path` and on `length`.
_ON_PATH = {StringEndsWith: str.endswith, StringStartsWith: str.startswith, StringContains: str.__contains__}
_ON_LENGTH = {
    EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__,
}


def _kept(row: tuple, filters: list[Filter]) -> bool:
    for f in filters:
        test = _ON_PATH.get(type(f))
        if test is not None and not test(row[0], f.value):
            return False
        test = _ON_LENGTH.get(type(f))
        if test is not None and not (row[2] is not None and test(int(row[2]), f.value)):
            return False
    return True


class FileListingReader(DataSourceReader):
    def __init__(self, path: str, folders: int, filesystem: pafs.FileSystem | None = None) -> None:
        self.fs = filesystem
        self.path = os.fsencode(local_path(path)) if filesystem is None else path.encode()
        self.folders = folders
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Conditions on the path (ends, starts with, contains) and on the length are applied while listing, so that
        a file they drop never becomes a row and is never read; all others are left to Spark."""
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("path",), ("length",)):
                continue  # listing rows always have both
            if (type(f) in _ON_PATH and f.attribute == ("path",) and isinstance(f.value, str)) or (
                type(f) in _ON_LENGTH and f.attribute == ("length",) and isinstance(f.value, int)
            ):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FolderPartition]:
        """At most `folders` partitions; a level with more folders than that is dealt out among them."""
        if self.fs is not None:
            return self._store_partitions()
        if not os.path.exists(self.path):
            raise FileNotFoundError(f"no such file or folder: {os.fsdecode(self.path)}")
        if os.path.isfile(self.path):
            return [FolderPartition([(self.path, False)])]
        done: list[tuple[bytes, bool]] = []
        level = deque([self.path])
        while level and len(done) + len(level) < self.folders:
            folder = level.popleft()
            done.append((folder, False))
            level.extend(_subfolders(folder))
        found = done + [(folder, True) for folder in level]
        return [FolderPartition(found[i :: self.folders]) for i in range(min(self.folders, len(found)))]

    def _store_partitions(self) -> list[FolderPartition]:
        info = self.fs.get_file_info(self.path.decode())
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {self.path.decode()}")
        if info.type != pafs.FileType.Directory:
            return [FolderPartition([(self.path, False)])]
        done: list[tuple[bytes, bool]] = []
        level = deque([self.path])
        while level and len(done) + len(level) < self.folders:
            folder = level.popleft()
            done.append((folder, False))
            level.extend(p.encode() for p in _store_subfolders(self.fs, folder.decode()))
        found = done + [(folder, True) for folder in level]
        return [FolderPartition(found[i :: self.folders]) for i in range(min(self.folders, len(found)))]

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for folder, recursive in partition.folders:
            if self.fs is None:
                listed = (_listed(path, error) for path, error in _files(folder, recursive))
            else:
                listed = _store_files(self.fs, folder.decode(), recursive)
            for row in listed:
                if row is not None and _kept(row, self.filters):
                    rows.append(row)
                if len(rows) >= ROWS_PER_BATCH:
                    yield _listing_batch(rows)
                    rows = []
        if rows:
            yield _listing_batch(rows)


def local_path(path: str) -> str:
    """The absolute path, since tasks run in folders of their own."""
    return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def _listed(path: bytes, error: str | None) -> tuple | None:
    """The row of a path, or None for what is no regular file, as a socket."""
    shown = path.decode("utf-8", "backslashreplace")
    if error is None:
        try:
            info = os.stat(path)
        except OSError as fault:
            error = _message(fault)
            if error is None:
                raise
        else:
            if not stat.S_ISREG(info.st_mode):
                return None
            return shown, info.st_mtime_ns // 1000, info.st_size, path, None
    return shown, None, 0, path, error


def _listing_batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, times, sizes, raw_paths, errors = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(paths, pa.string()),
            pa.array(times, pa.int64()).cast(pa.timestamp("us", tz="UTC")),
            pa.array(sizes, pa.int64()),
            pa.array(raw_paths, pa.binary()),
            pa.array(errors, pa.string()),
        ],
        names=["path", "modificationTime", "length", "raw_path", "read_error"],
    )


def _subfolders(folder: bytes) -> list[bytes]:
    """Subfolders for sharing out. A folder that cannot be read has none here; its row comes from the task that lists it."""
    try:
        with os.scandir(folder) as entries:
            return [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    except OSError as fault:
        if _message(fault) is None:
            raise
        return []


def _files(folder: bytes, recursive: bool) -> Iterator[tuple[bytes, str | None]]:
    """Files in a folder, and folders that cannot be read with the message; links to folders are not followed."""
    if os.path.isfile(folder):
        yield folder, None
        return
    waiting = [folder]
    while waiting:
        current = waiting.pop()
        try:
            with os.scandir(current) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        if recursive:
                            waiting.append(entry.path)
                    else:
                        yield entry.path, None
        except OSError as fault:
            error = _message(fault)
            if error is None:
                raise
            yield current, error


def _store_subfolders(fs: pafs.FileSystem, folder: str) -> list[str]:
    try:
        infos = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    except OSError as fault:
        if _message(fault) is None:
            raise
        return []
    return [i.path for i in infos if i.type == pafs.FileType.Directory]


def _store_files(fs: pafs.FileSystem, folder: str, recursive: bool) -> Iterator[tuple]:
    """Listing rows of the files in a folder of a store, and of a folder that cannot be read, with the message."""
    try:
        info = fs.get_file_info(folder)
        infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(folder, recursive=recursive))
    except OSError as fault:
        error = _message(fault)
        if error is None:
            raise
        yield folder, None, 0, folder.encode(), error
        return
    for i in infos:
        if i.type == pafs.FileType.File:
            changed = None if i.mtime_ns is None else i.mtime_ns // 1000
            yield i.path, changed, i.size or 0, i.path.encode(), None


def list_files(spark: SparkSession, path: str, filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """All files under a folder: path, modificationTime, length, raw_path, and read_error where there is one.

    `filesystem` (pyarrow) lists a store that is not mounted; a URI with a scheme other than `file` finds its own.
    """
    spark.dataSource.register(FileListing)
    # The listing source applies conditions on path and length itself (`pushFilters`); Spark asks for this switch.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folders = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    fs, inner = store_of(path, filesystem)
    reader = spark.read.format("piisieve_listing").option("folders", str(folders))
    if fs is not None:
        reader = reader.option("filesystem", base64.b64encode(pickle.dumps(fs)).decode())
    return reader.load(inner)


def read_listed(files: DataFrame, partitions: int, skip_pdf: bool = False, filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """Add the content of listed files.

    Only the listing is shuffled, so one folder may hold most of the files without one task reading
    them all. Of a file that no extractor takes only the first HEAD_BYTES are read; `skip_pdf` says that PDFs
    are among those.
    """
    read = partial(_read_contents, skip_pdf=skip_pdf, fs=filesystem)
    return dealt_by_bytes(files, partitions).mapInArrow(read, FILE_DDL)


def dealt_by_bytes(files: DataFrame, partitions: int) -> DataFrame:
    """The listing in `partitions` partitions of about equal bytes, not equal counts of files.

    Each file's place in a running sum of sizes (the sums of the listing's partitions first, then a running sum inside
    each) gives it the range of bytes it falls in; ranges are dealt one to a partition. A task then reads at most its
    share of bytes and one more file, however the sizes are spread. Only the listing moves, never content.
    """
    size = F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(1))  # files without bytes still cost a little
    placed = files.withColumn("_part", F.spark_partition_id()).withColumn("_size", size)
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_total"))
    before_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_total").over(before_part), F.lit(0)).alias("_offset"), F.sum("_total").over(Window.partitionBy()).alias("_all")
    )
    before_file = Window.partitionBy("_part").orderBy("path", "raw_path").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_size").over(before_file), F.lit(0))
    )
    share = F.col("_all") / partitions
    slot = F.least(F.floor(F.col("_before") / share), F.lit(partitions - 1)).cast("int")
    dealt = ranked.withColumn("_slot", slot).repartitionByRange(partitions, "_slot")
    return dealt.drop("_part", "_size", "_offset", "_all", "_before", "_slot")


def _read_contents(batches: Iterator[pa.RecordBatch], skip_pdf: bool, fs: pafs.FileSystem | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for row in batch.to_pylist():
            content, error, unreadable = None, row["read_error"], True
            if error is None:
                content, error, unreadable = _read_file(row["raw_path"], row["path"], row["length"], skip_pdf, fs)
            rows.append((row["path"], row["modificationTime"], row["length"], content, error, unreadable))
            size += len(content or b"")
            if size >= BYTES_PER_BATCH:
                yield _content_batch(rows)
                rows, size = [], 0
        if rows:
            yield _content_batch(rows)


def _read_file(
    raw_path: bytes, path: str, length: int, skip_pdf: bool, fs: pafs.FileSystem | None = None
) -> tuple[bytes | None, str | None, bool]:
    """Content, or its head where no extractor takes it; or the error and whether the file could not be opened."""
    try:
        with open(raw_path, "rb") if fs is None else fs.open_input_stream(raw_path.decode()) as file:
            head = file.read(HEAD_BYTES)
            if not is_routed(path, head, skip_pdf):
                return head, None, False
            if length > LARGEST_FILE:
                return None, f"file of {length} bytes is too large for one row", False
            return (head + file.read() if len(head) == HEAD_BYTES else head), None, False
    except OSError as error:
        message = _message(error)
        return None, message or str(error), message is not None


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, times, sizes, contents, errors, unreadable = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(paths, pa.string()),
            pa.array(times, pa.timestamp("us", tz="UTC")),
            pa.array(sizes, pa.int64()),
            pa.array(contents, pa.binary()),
            pa.array(errors, pa.string()),
            pa.array(unreadable, pa.bool_()),
        ],
        names=["path", "modificationTime", "length", "content", "read_error", "unreadable"],
    )


def read_files(
    spark: SparkSession,
    path: str,
    partitions: int | None = None,
    skip_pdf: bool = False,
    filesystem: pafs.FileSystem | None = None,
    where=None,
) -> DataFrame:
    """All files under a path with their content, or its head where no extractor takes it.

    `where`, a condition on the listing's columns (path, modificationTime, length, read_error), is applied before any
    file is opened; its parts on path and length are applied by the listing itself.

    Every store is listed exactly, hidden and empty files included: a mounted path by the operating system, any other
    through `filesystem` or the pyarrow file system of its URI. Without `partitions` the files are listed once more
    for the sum of their sizes, and a task gets about BYTES_PER_TASK.
    """
    fs, inner = store_of(path, filesystem)
    files = list_files(spark, inner, fs)
    if where is not None:
        files = files.where(where)
    if partitions is None:
        total = files.agg(F.sum("length")).first()[0] or 0
        partitions = max(spark.sparkContext.defaultParallelism * TASKS_PER_CORE, ceil(total / BYTES_PER_TASK))
    return read_listed(files, partitions, skip_pdf, fs)
