"""Helpers that the operators share: hashing ids, worker state, shared storage, batches."""

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words: space and \t \n \v \f \r. `bytes.split()` splits at the same bytes.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

# Texts are handed to Python kernels in slices of about so many characters.
SLICE_CHARS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; a null text has none."""
    return (text or "").encode().split()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def worker_state(name: str, build: Callable[[], Any]) -> Any:
    """An object that is built once per Python worker.

    The code may be sent to the workers by value, which gives each task its own module globals, so the
    object is kept in a module of its own in `sys.modules`.
    """
    holder = sys.modules.setdefault("piisieve_llm_worker_state", types.ModuleType("piisieve_llm_worker_state"))
    if name not in holder.__dict__:
        holder.__dict__[name] = build()
    return holder.__dict__[name]


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the cluster's checkpoint folder (`spark.checkpoint.dir`).

    Where none is set and Spark runs in one process (`local` master, as in tests), a temporary folder is taken: driver
    and executors share it there. On a cluster an unset folder is an error, since a folder of one machine would lose
    what the others write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = worker_state("checkpoints", lambda: tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{base.rstrip('/')}/piisieve-{uuid.uuid4().hex}"


def written(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it again: cuts the lineage, runs its work once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of consecutive texts of about SLICE_CHARS characters; a null text becomes an empty one."""
    part: list[str] = []
    chars = 0
    for text in texts:
        part.append(text or "")
        chars += len(part[-1])
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def is_word_text(text: str | None) -> bool:
    return bool(text) and re.search(WORD, text) is not None
