"""Run detectors over the text column of a DataFrame."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matches import (
    HITS_TYPE, LONG_TEXT, context_window, first_places, group_offsets, split_offsets, start_offsets, text_blocks, unique_offsets,
)
from ..schema import FINDING_STRUCT
from .detector import Detector, PythonDetector, RuleDetector, finding_fields, no_findings
from .registry import default_registry

_CANDIDATES = "_candidates_"
_FIRST, _SECOND, _PLACED = "_first_", "_second_", "_placed_"
_STARTS = "_starts"
_BLOCKS = "_text_blocks"
_RULE, _HITS, _VALUE, _START, _CONTEXT = "_rule", "_hits", "_value", "_start", "_context"


def _chosen(detectors: Iterable[str | Detector] | None) -> list[Detector]:
    """Names are looked up among the built-in detectors; records are taken as they are.

    Nothing asked for means all built-in ones; only unknown names mean none.
    """
    registry = default_registry()
    asked = list(detectors or registry.all())
    chosen: dict[str, Detector] = {}
    for item in asked:
        for detector in registry.select([item]) if isinstance(item, str) else [item]:
            chosen.setdefault(detector.name.lower(), detector)
    return list(chosen.values())


def _all_starts(text: Column, detectors: Sequence[tuple[RuleDetector, Column]]) -> Column:
    """For each detector the offsets of its matches, NULL where it has none."""
    if not detectors:
        return F.lit(None)
    none = F.lit(None).cast("array<int>")
    matched = [
        F.struct(
            F.when(F.lit(not d.takes_ends), found).alias("wholes"),
            F.lit(d.pattern).alias("pattern"),
            (F.when(F.size(found) > 0, group_offsets(text, d.pattern, found)) if d.takes_ends else none).alias("placed"),
        )
        for d, found in detectors
    ]
    return F.transform(
        F.array(*matched),
        lambda m: F.coalesce(
            m["placed"], F.when(F.size(m["wholes"]) > 0, start_offsets(text, m["pattern"], m["wholes"]))
        ),
    )


def _placed(text: Column, detector: RuleDetector, found: Column, first: Column, second: Column) -> Column:
    """The offsets of one or two matches; NULL for any other number and for groups that a search cannot place."""
    unique = unique_offsets(text, found, first, second)
    return unique if detector.takes_ends else F.coalesce(unique, split_offsets(text, detector.pattern, found))


def _measured(df: DataFrame, text: Column, chosen: Sequence[Detector]) -> tuple[DataFrame, list[Column], list[Column | None]]:
    """df with what each detector found, the offsets and the text in blocks; the first two per detector as columns.

    One or two matches of a detector, which most texts with any hold, are placed by plain columns; only the detectors with
    more, or with groups that the search cannot place, go through `_all_starts`. The projections stay apart in the plan because
    each column of one is used several times in the next.
    """
    columns = [F.col(f"{_CANDIDATES}{i}") for i in range(len(chosen))]
    searched = df.select(
        "*", *[d.candidates(text).alias(f"{_CANDIDATES}{i}") for i, d in enumerate(chosen)]
    )
    by_pattern = [(d, c) for d, c in zip(chosen, columns, strict=True) if isinstance(d, RuleDetector)]
    any_found = F.lit(False)
    for column in columns:
        any_found = any_found | (F.coalesce(F.size(column), F.lit(0)) > 0)
    looked_up, few = {}, {}
    for i, (d, c) in enumerate(by_pattern):
        first, second = f"{_FIRST}{i}", f"{_SECOND}{i}"
        looked_up[first], looked_up[second] = first_places(text, c)
        few[f"{_PLACED}{i}"] = _placed(text, d, c, F.col(first), F.col(second))
    placed = [F.col(name) for name in few]
    rest = [(d, F.when(p.isNull(), c)) for (d, c), p in zip(by_pattern, placed, strict=True)]
    left = F.lit(False)
    for _, found in rest:
        left = left | (F.coalesce(F.size(found), F.lit(0)) > 0)
    measured = (
        searched.withColumns(looked_up)
        .withColumns(few)
        .withColumns(
            {
                _STARTS: F.when(left, _all_starts(text, rest)),
                _BLOCKS: F.when(any_found & (F.length(text) > LONG_TEXT), text_blocks(text)),
            }
        )
    )
    places = {d.name: F.coalesce(placed[i], F.get(F.col(_STARTS), F.lit(i))) for i, (d, _) in enumerate(by_pattern)}
    return measured, columns, [places.get(d.name) for d in chosen]


def with_findings(
    df: DataFrame,
    text_col: str = "text",
    detectors: Iterable[str | Detector] | None = None,
    output_col: str = "findings",
) -> DataFrame:
    """Add the array of all findings in each row's text.

    Every detector reads the text in the same pass and nothing is shuffled. The last step is an
    explode of one element, which gives one row per row: the optimizer moves a condition on `findings`
    no further down than that, where it would otherwise run every pattern a second time.
    """
    chosen = _chosen(detectors)
    text = F.col(text_col)
    if not chosen:
        return df.withColumn(output_col, no_findings())

    measured, columns, starts = _measured(df, text, chosen)
    parts: list[Column] = [
        d.findings(text, column, start, F.col(_BLOCKS))
        for d, column, start in zip(chosen, columns, starts, strict=True)
    ]
    findings = F.explode(F.array(F.concat(*parts))).alias(output_col)
    return measured.select(*[F.col(c) for c in df.columns], findings)


def _valid(detector: RuleDetector, hits: Column) -> Column:
    """The hits whose value passes the detector's checksum.

    Checked on the array, once per row and before any hit becomes a row: a check after the unfolding that is
    not generated code (one with a lambda, say) would make the unfolding buffer a copy of the row, text and
    all, for every hit.
    """
    validator = detector.validator
    return hits if validator is None else F.filter(hits, lambda hit: validator(hit["value"]))


def _hits(df: DataFrame, text_col: str, keep: Sequence[str], rules: Sequence[RuleDetector]) -> DataFrame:
    """One row per finding of rule detectors.

    Checksums are applied to each detector's array of hits; then the hits are unfolded, so that contexts and
    scores are plain columns in generated code and not expressions inside lambdas over an array. Above the
    unfolding no row is filtered, so the text is never copied per hit.
    """
    text = F.col(text_col)
    measured, columns, starts = _measured(df, text, rules)
    hits = [
        F.when(F.size(c) > 0, _valid(d, d.hits(text, c, s))).otherwise(F.array().cast(HITS_TYPE))
        for d, c, s in zip(rules, columns, starts, strict=True)
    ]
    found = F.inline(F.array(*[F.struct(F.lit(i), h) for i, h in enumerate(hits)])).alias(_RULE, _HITS)
    carried = list(dict.fromkeys([*keep, text_col]))
    rows = measured.select(*carried, _BLOCKS, found)
    rows = rows.select(*carried, _BLOCKS, _RULE, F.inline(_HITS).alias(_VALUE, _START))

    def by_rule(values: Sequence[Column]) -> Column:
        """The value for the row's detector."""
        chosen = values[-1]
        for i in range(len(values) - 2, -1, -1):
            chosen = F.when(F.col(_RULE) == i, values[i]).otherwise(chosen)
        return chosen

    value, start = F.col(_VALUE), F.col(_START)
    window = by_rule([F.lit(d.window) for d in rules])
    around = context_window(text, start, F.length(value), window, F.col(_BLOCKS))
    rows = rows.select(*keep, _RULE, _VALUE, _START, around.alias(_CONTEXT))
    context = F.col(_CONTEXT)
    fields = finding_fields(
        by_rule([F.lit(d.pii_type) for d in rules]),
        value,
        by_rule([d.score_of(context) for d in rules]),
        by_rule([F.lit(d.name) for d in rules]),
        by_rule([F.lit(d.validation) for d in rules]),
        context,
        by_rule([d.location_of(start) for d in rules]),
        start,
    )
    return rows.select(*keep, *fields)


def flatten_findings(df: DataFrame, keep: Sequence[str], findings_col: str = "findings") -> DataFrame:
    """One row per finding with the `keep` columns in front."""
    names = [field.name for field in FINDING_STRUCT.fields]
    return df.select(*keep, F.inline(findings_col).alias(*names))


def scan(
    df: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id", "file_path"),
    detectors: Iterable[str | Detector] | None = None,
) -> DataFrame:
    """All findings in a text column, one row each.

    `keep` names the columns that identify the row; they are carried to each of its findings.
    `detectors` are names of built-in detectors or detector records; none given means all built-in ones.
    """
    detectors = list(detectors or ())
    asked = [c for d in _chosen(detectors) if isinstance(d, PythonDetector) for c in d.columns]
    columns = list(dict.fromkeys([*keep, text_col, *asked]))
    chosen = _chosen(detectors)
    if chosen and all(type(d) is RuleDetector for d in chosen):
        return _hits(df.select(*columns), text_col, keep, chosen)
    found = with_findings(df.select(*columns), text_col, detectors)
    return flatten_findings(found, keep)
