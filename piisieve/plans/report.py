"""The report over findings and how it is written."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import risk_tier
from ..schema import REPORT_COLUMNS


def to_report(findings: DataFrame) -> DataFrame:
    """The six report columns in order, and the risk tier that a sheet would show as a colour."""
    return findings.select(
        *[F.col(source).alias(title) for title, source in REPORT_COLUMNS.items()],
        risk_tier(F.col("confidence_score")).alias("risk_tier"),
    )


def default_report_name(now: datetime | None = None) -> str:
    return f"scan_report_{now or datetime.now():%Y%m%d_%H%M%S}"


def write_report(
    findings: DataFrame,
    path: str,
    file_format: str = "parquet",
    overwrite: bool = False,
    partition_by: Sequence[str] = (),
) -> None:
    """Write the report; an existing one is only replaced with `overwrite`.

    Rows are ordered within each file by document, place and type. A total order would need a range
    shuffle whose sampling runs the scan a second time; sort the written table where one is wanted.
    No findings give an empty table with the report's columns.
    """
    ordered = findings.sortWithinPartitions("doc_id", "start_pos", "pii_type")
    writer = to_report(ordered).write.format(file_format)
    writer = writer.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.save(path)


def count_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"))


def count_failed(documents: DataFrame) -> DataFrame:
    """Files that failed in a way no extractor reported."""
    return documents.agg(F.count_if("failed").alias("failed_files"))


def report_is_due(findings, failed_files):
    """A report is written unless nothing was found while files failed. Takes numbers or columns."""
    return (findings > 0) | (failed_files == 0)


def total_columns() -> list:
    """The counts of scanned documents as aggregates: files, findings, failed files."""
    return [
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"),
        F.count_if("failed").alias("failed_files"),
    ]


def scan_totals(scanned: DataFrame) -> DataFrame:
    """Files, findings, failed files, and whether a report is due, over scanned documents."""
    totals = scanned.agg(*total_columns())
    return totals.withColumn("report_due", report_is_due(F.col("findings"), F.col("failed_files")))
