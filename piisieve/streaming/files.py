"""A stream of the files under a folder, hidden and empty ones included, read once each.

Spark's `binaryFile` stream leaves out names that begin with `.` or `_` and keeps no row for them. This source lists a
folder exactly, as `list_files` does (the operating system for a mounted path, `pyarrow.fs` for any other store), and
takes files in the order of (modification time, path). The offset of a micro-batch is the (time, path) of its last
file, so a restart from the checkpoint reads nothing twice; each batch deals its files over tasks, which read them.

A file that turns up later with a modification time before the last offset is not taken: stores that keep times of
writing, as object stores do, give none such.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import listing

FILES_PER_PARTITION = 64
STREAM_DDL = "path string, modificationTime timestamp, length bigint, content binary, read_error string, unreadable boolean"


@dataclass
class FilesPartition(InputPartition):
    """Listing rows (path, time in microseconds, length, raw path) of the files that one task reads."""

    files: list[tuple]


class FileStream(DataSource):
    """`spark.readStream.format("piisieve_files").load(path)`; option `filesystem` as for `list_files`."""

    @classmethod
    def name(cls) -> str:
        return "piisieve_files"

    def schema(self) -> str:
        return STREAM_DDL

    def streamReader(self, schema) -> "FileStreamReader":
        store = self.options.get("filesystem")
        fs = listing.pickle.loads(listing.base64.b64decode(store)) if store else None
        return FileStreamReader(self.options["path"], fs, int(self.options.get("filesPerPartition", FILES_PER_PARTITION)))


def _key(row: tuple) -> list:
    return [row[1] if row[1] is not None else -1, row[0]]


class FileStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, fs, per_partition: int) -> None:
        self.fs, self.path = listing.store_of(path, fs)
        self.per_partition = per_partition

    def _listed(self) -> list[tuple]:
        """All listing rows, sorted by (time, path); errors of folders have no time and come first."""
        reader = listing.FileListingReader(self.path, 1, self.fs)
        rows = [
            row
            for part in reader.partitions()
            for batch in reader.read(part)
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        ]
        out = []
        for path, changed, length, raw, error in rows:
            micros = None if changed is None else int(changed.timestamp() * 1_000_000)
            out.append((path, micros, length, raw, error))
        return sorted(out, key=_key)

    def initialOffset(self) -> dict:
        return {"after": None}

    def latestOffset(self) -> dict:
        rows = self._listed()
        return {"after": _key(rows[-1]) if rows else None}

    def partitions(self, start: dict, end: dict) -> list[FilesPartition]:
        low, high = start.get("after"), end.get("after")
        chosen = [r for r in self._listed() if (low is None or _key(r) > low) and (high is not None and _key(r) <= high)]
        step = self.per_partition
        return [FilesPartition(chosen[i : i + step]) for i in range(0, len(chosen), step)]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, micros, length, raw, error in partition.files:
            content, unreadable = None, True
            if error is None:
                content, error, unreadable = listing._read_file(raw, path, length, False, self.fs)
            rows.append((path, micros, length, content, error, unreadable))
        if rows:
            paths, times, lengths, contents, errors, unreadable = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(paths, pa.string()),
                    pa.array(times, pa.int64()).cast(pa.timestamp("us", tz="UTC")),
                    pa.array(lengths, pa.int64()),
                    pa.array(contents, pa.binary()),
                    pa.array(errors, pa.string()),
                    pa.array(unreadable, pa.bool_()),
                ],
                names=["path", "modificationTime", "length", "content", "read_error", "unreadable"],
            )

    def commit(self, end: dict) -> None:
        pass


def stream_files(spark, path: str, filesystem=None):
    """The files under `path` as a stream: one row each, with content, or the error that kept it from being read."""
    spark.dataSource.register(FileStream)
    reader = spark.readStream.format("piisieve_files")
    if filesystem is not None:
        reader = reader.option("filesystem", listing.base64.b64encode(listing.pickle.dumps(filesystem)).decode())
    return reader.load(path)
