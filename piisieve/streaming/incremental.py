"""Scan only the files that have arrived since the last run."""

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detector import Detector
from ..plans.job import scan_documents
from ..sources.extract import extract_text
from .files import stream_files


def scan_new_files(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    detectors: Iterable[str | Detector] | None = None,
    pdf_extractor: Callable[[bytes], str] | None = None,
) -> StreamingQuery:
    """Append one row per new file, with status and findings, to the table at `output`, then stop.

    The scan keeps no state, so this is the batch scan on a stream: the checkpoint remembers the (time, path) of the
    last file done, and a failed run is taken up where it stopped. Hidden and empty files have rows like any other
    (`streaming/files.py`). `checkpoint` must be storage that all nodes share.
    """
    files = stream_files(spark, path)
    return (
        scan_documents(extract_text(files, pdf_extractor), detectors)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
