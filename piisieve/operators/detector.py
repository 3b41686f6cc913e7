"""What a detector is: a table-valued operator from a text to an array of findings.

A scan evaluates a detector in two steps, each in its own projection, so that nothing costly is worked
out twice: `candidates` looks through the text, `findings` builds rows from what was found. In between
the scan works out the offsets of all pattern detectors' matches with one expression.
"""

import logging
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.matches import (
    around_group, context_window, ends_with_group, hits_at, location_label, matches_empty, whole_matches,
)
from ..functions.scoring import keyword_score
from ..schema import FINDING_STRUCT, FINDINGS_TYPE

log = logging.getLogger(__name__)


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def finding_fields(*columns: Column) -> list[Column]:
    """The columns of a finding, in the order of FINDING_STRUCT, with its names and types."""
    return [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, FINDING_STRUCT.fields, strict=True)]


@dataclass(frozen=True)
class Detector:
    """Base of all detectors. `name` is reported as the finding's source."""

    name: str
    pii_type: str

    def __post_init__(self) -> None:
        if not self.name or not self.pii_type:
            raise TypeError("a detector needs a name and a pii_type")

    def candidates(self, text: Column) -> Column:
        """An array that is empty or NULL where the text holds nothing for this detector."""
        raise NotImplementedError

    def findings(
        self, text: Column, candidates: Column, starts: Column | None, blocks: Column
    ) -> Column:
        """`array<finding>` from the candidates.

        `starts` has the offset of each candidate of a detector with a `pattern`; `blocks` is the text
        in pieces where it is long, see `context_window`.
        """
        raise NotImplementedError


@dataclass(frozen=True)
class RuleDetector(Detector):
    """A detector that is plain data: a pattern, a window, a score, keywords and a checksum.

    `guards` are conditions every text with a match meets. They are cheap, so the pattern only runs on
    texts that may match. `group` = 1 means that the hit is the pattern's first group. A pattern that
    matches an empty text is refused, as are groups that cannot be placed (see `around_group`).
    """

    pattern: str = ""
    window: int = 10
    score: float = 0.5
    positive: Sequence[str] = ()
    negative: Sequence[str] = ()
    ignore_case: bool = False
    validator: Callable[[Column], Column] | None = None
    has_location: bool = True
    group: int = 0
    guards: Sequence[Callable[[Column], Column]] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.pattern:
            raise TypeError(f"{self.name} needs a pattern")
        if not 0.0 <= self.score <= 1.0:
            raise ValueError(f"{self.name}: score {self.score} is outside 0 to 1")
        if matches_empty(self.pattern):
            raise ValueError(f"{self.name}: the pattern matches an empty text")
        if self.group not in (0, 1):
            raise ValueError(f"{self.name}: group {self.group} is neither 0 nor 1")
        if self.group == 1:
            around_group(self.pattern)

    @property
    def takes_ends(self) -> bool:
        """Whether a hit is a group that ends the pattern: then candidates are the groups, with their own offsets."""
        return self.group == 1 and ends_with_group(self.pattern)

    def candidates(self, text: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)) if self.takes_ends else whole_matches(text, self.pattern)
        if not self.guards:
            return matches
        # Nested rather than joined by AND: the first guard is shared by several detectors and is then
        # worked out once per text.
        for guard in reversed(self.guards):
            matches = F.when(guard(text), matches)
        return matches

    def findings(
        self, text: Column, candidates: Column, starts: Column | None, blocks: Column
    ) -> Column:
        hits = self.hits(text, candidates, starts)
        if self.validator is not None:
            validator = self.validator
            hits = F.filter(hits, lambda hit: validator(hit["value"]))
        rows = F.transform(hits, lambda hit: self._finding(text, hit, blocks))
        return F.when(F.size(candidates) > 0, rows).otherwise(no_findings())

    def hits(self, text: Column, candidates: Column, starts: Column) -> Column:
        """`array<struct<value, start>>` of the candidates; the checksum has not been looked at."""
        if self.takes_ends:
            return hits_at(text, self.pattern, candidates, starts)
        return hits_at(text, self.pattern, candidates, starts, self.group)

    @property
    def validation(self) -> str:
        return "NOT_APPLICABLE" if self.validator is None else "VALID"

    def score_of(self, context: Column) -> Column:
        if self.positive or self.negative:
            return keyword_score(context, self.score, self.positive, self.negative, self.ignore_case)
        return F.lit(float(self.score))

    def location_of(self, start: Column) -> Column:
        return location_label(start) if self.has_location else F.lit(None).cast("string")

    def _finding(self, text: Column, hit: Column, blocks: Column) -> Column:
        value, start = hit["value"], hit["start"]

        def row(context: Column) -> Column:
            return F.struct(
                *finding_fields(
                    F.lit(self.pii_type),
                    value,
                    self.score_of(context),
                    F.lit(self.name),
                    F.lit(self.validation),
                    context,
                    self.location_of(start),
                    start,
                )
            )

        return let(context_window(text, start, F.length(value), self.window, blocks), row)


RAW_FINDING = (
    "matched_value string, confidence_score double, validation_status string, "
    "context string, location string, start_pos int"
)
RAW_FINDING_TYPE = pa.list_(
    pa.struct(
        [
            ("matched_value", pa.string()), ("confidence_score", pa.float64()), ("validation_status", pa.string()),
            ("context", pa.string()), ("location", pa.string()), ("start_pos", pa.int32()),
        ]
    )
)


@dataclass(frozen=True)
class PythonDetector(Detector):
    """A detector written as a Python function from a text to its findings.

    `scan(text)` returns mappings with `matched_value`, `confidence_score` and `start_pos`, and
    optionally `context`, `location` and `validation_status`. With `columns`, the function is called as
    `scan(text, row)` with a mapping of these columns of the text's row, such as `file_path`, `mime_type` and
    `file_size_bytes` of scanned files. It runs in Arrow batches on the executors.
    If it raises, or gives a score outside 0 to 1, this detector has no findings for that text; other
    detectors and other texts are unaffected.
    """

    scan: Callable[..., Iterable[Mapping]] | None = None
    window: int = 10
    guards: Sequence[Callable[[Column], Column]] = ()
    columns: Sequence[str] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if not callable(self.scan):
            raise TypeError(f"{self.name} needs a scan function")

    def candidates(self, text: Column) -> Column:
        scan, name = self.scan, self.name
        kind = f"array<struct<{RAW_FINDING.replace(' ', ':').replace(',:', ',')}>>"

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda value: None if value is None else _run_scan(scan, name, value))

        @F.arrow_udf(kind)
        def run_with_row(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, rows in batches:
                found = [
                    None if text is None else _run_scan(scan, name, text, row)
                    for text, row in zip(texts.to_pylist(), rows.to_pylist(), strict=True)
                ]
                yield pa.array(found, RAW_FINDING_TYPE)

        # Texts that fail a guard are sent as NULL, so they never cross to Python.
        for guard in self.guards:
            text = F.when(guard(text), text)
        if self.columns:
            return run_with_row(text, F.struct(*self.columns))
        return run(text)

    def findings(
        self, text: Column, candidates: Column, starts: Column | None, blocks: Column
    ) -> Column:
        def row(raw: Column) -> Column:
            start = raw["start_pos"]
            around = context_window(
                text, start, F.length(raw["matched_value"]), self.window, blocks
            )
            return F.struct(
                F.lit(self.pii_type).alias("pii_type"),
                raw["matched_value"].alias("matched_value"),
                raw["confidence_score"].alias("confidence_score"),
                F.lit(self.name).alias("scanner_source"),
                raw["validation_status"].alias("validation_status"),
                F.coalesce(raw["context"], around).alias("context"),
                raw["location"].alias("location"),
                start.alias("start_pos"),
            )

        return F.when(F.size(candidates) > 0, F.transform(candidates, row)).otherwise(no_findings())


def _run_scan(scan: Callable, name: str, *args) -> list[dict]:
    try:
        rows = []
        for item in scan(*args) or ():
            score = float(item["confidence_score"])
            if not 0.0 <= score <= 1.0:
                raise ValueError(f"confidence score {score} is outside 0 to 1")
            start = item.get("start_pos")
            rows.append(
                {
                    "matched_value": str(item["matched_value"]),
                    "confidence_score": score,
                    "validation_status": item.get("validation_status", "NOT_APPLICABLE"),
                    "context": item.get("context"),
                    "location": item.get("location"),
                    "start_pos": None if start is None else int(start),
                }
            )
        return rows
    except Exception:
        log.exception("detector %s failed on a text", name)
        return []
