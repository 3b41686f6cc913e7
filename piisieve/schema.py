"""Row shapes and fixed codes shared by every job in the package."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status and validation codes with their display labels.
STATUS_LABELS = {
    "PENDING": "待處理",
    "PARSING": "解析中",
    "COMPLETED": "處理完成",
    "SKIPPED": "已跳過",
    "ERROR": "處理錯誤",
}
VALIDATION_LABELS = {
    "VALID": "驗證通過",
    "INVALID": "驗證失敗",
    "NOT_APPLICABLE": "不適用",
}

# The report's column titles, in report order, with the finding column each one shows.
REPORT_COLUMNS = {
    "個資類型": "pii_type",
    "符合內容": "matched_value",
    "信賴分數": "confidence_score",
    "檔案路徑": "file_path",
    "掃描來源": "scanner_source",
    "上下文": "context",
}

# One file (or one row of any text table) and what became of it.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("text", T.StringType()),
    ]
)

# One finding as it sits in a document row's `findings` array.
FINDING_STRUCT = T.StructType(
    [
        T.StructField("pii_type", T.StringType()),
        T.StructField("matched_value", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("scanner_source", T.StringType()),
        T.StructField("validation_status", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
    ]
)
FINDINGS_TYPE = T.ArrayType(FINDING_STRUCT)

# The flat findings table: the document's keys, the finding, and the time of the scan.
FINDING_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("file_path", T.StringType())]
    + FINDING_STRUCT.fields
    + [T.StructField("timestamp_utc", T.TimestampType())]
)


def _label(code: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])[code]


def status_label(code: Column) -> Column:
    """Display label of a file status code."""
    return _label(code, STATUS_LABELS)


def validation_label(code: Column) -> Column:
    """Display label of a validation code."""
    return _label(code, VALIDATION_LABELS)
