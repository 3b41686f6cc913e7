"""A scan from a folder to a report."""

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.detector import Detector
from ..operators.registry import default_registry
from ..operators.scan import flatten_findings, with_findings
from ..schema import FINDING_SCHEMA
from ..sources.extract import extract_text
from ..sources.listing import read_files
from .report import default_report_name, report_is_due, total_columns, write_report

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ScanOutcome:
    """Where a scan wrote its tables (`report` is None where none was due) and its two counts."""

    documents: str
    report: str | None
    findings: int
    failed_files: int


def scan_documents(
    documents: DataFrame, detectors: Iterable[str | Detector] | None = None
) -> DataFrame:
    """Documents without their text, each with the array of its findings; one pass, no shuffle."""
    return with_findings(documents, "text", detectors).drop("text")


def findings_of(scanned: DataFrame) -> DataFrame:
    """The flat findings table of scanned documents, with the time of the document's scan; without one, the present."""
    if "timestamp_utc" not in scanned.columns:
        scanned = scanned.withColumn("timestamp_utc", F.current_timestamp())
    return flatten_findings(scanned, ["doc_id", "file_path", "timestamp_utc"]).select(FINDING_SCHEMA.names)


def scan_files(
    spark: SparkSession,
    path: str,
    output: str | None = None,
    detectors: Sequence[str] | None = None,
    overwrite: bool = False,
    extra_detectors: Iterable[Detector] = (),
    predictor_factory: Callable | None = None,
    pdf_extractor: Callable[[bytes], str] | None = None,
    file_format: str = "parquet",
    partition_by: Sequence[str] = (),
    partitions: int | None = None,
) -> ScanOutcome | None:
    """Scan a file or folder and write `documents` and `report` under `output`.

    The files are read once: that pass writes one row per file with its status and findings, and counts them as it
    writes (an `Observation`). The report comes from that table, which is as small as the findings, not from the files.
    Returns None if no known detector was asked for.
    """
    registry = default_registry(predictor_factory)
    for detector in extra_detectors:
        registry.add(detector)
    chosen = registry.select(detectors)
    if not chosen:
        log.warning("no detector is enabled, nothing to scan")
        return None

    output = output or default_report_name()
    documents_path, report_path = f"{output}/documents", f"{output}/report"
    files = read_files(spark, path, partitions, skip_pdf=pdf_extractor is None)
    scanned = scan_documents(extract_text(files, pdf_extractor), chosen)
    # The counts are taken while the documents are written (from successful tasks only), not by reading them again.
    counted = Observation("scan_totals")
    scanned.observe(counted, *total_columns()).write.mode("overwrite" if overwrite else "errorifexists").parquet(documents_path)
    totals = counted.get
    files_seen, findings, failed = totals["files"], totals["findings"], totals["failed_files"]
    if files_seen == 0:
        log.warning("no files under %s", path)
    due = files_seen > 0 and report_is_due(findings, failed)
    if due:
        written = spark.read.schema(scanned.schema).parquet(documents_path)
        write_report(findings_of(written), report_path, file_format, overwrite, partition_by)
    return ScanOutcome(documents_path, report_path if due else None, findings, failed)
