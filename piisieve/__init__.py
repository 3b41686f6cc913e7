"""Find personal data in text at scale with Spark."""

from .operators.detector import Detector, PythonDetector, RuleDetector
from .operators.names import NameDetector
from .operators.registry import Registry, default_registry
from .operators.scan import flatten_findings, scan, with_findings
from .plans.job import findings_of, scan_documents, scan_files
from .plans.report import to_report, write_report
from .sources.extract import extract_text
from .sources.listing import list_files, read_files
from .streaming.incremental import scan_new_files

__all__ = [
    "Detector",
    "NameDetector",
    "PythonDetector",
    "Registry",
    "RuleDetector",
    "default_registry",
    "extract_text",
    "findings_of",
    "flatten_findings",
    "list_files",
    "read_files",
    "scan",
    "scan_documents",
    "scan_files",
    "scan_new_files",
    "to_report",
    "with_findings",
    "write_report",
]
