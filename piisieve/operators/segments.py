"""Long texts as segments: cut where no match can cross, scan the pieces as rows of their own, shift offsets back.

A cut is placed between two consecutive whitespace characters. None of the seven built-in patterns can match
across such a place: e-mail, national ID, health insurance number, passport and address hold no whitespace at all,
and card and phone numbers allow one separator between digits at most. Their lookbehinds only ask for "not a word
character / digit / e-mail character", which whitespace and the start of a string answer alike, and their
lookaheads likewise for the end; `\\G` at a segment's start meets a position that a whitespace character follows,
where no hit can begin. So the leftmost non-overlapping matches of a stretch between two cuts are exactly those of
the whole text there, and each segment is scanned on its own.

Each segment owns the hits that start in its core [c_k, c_k+1). It is scanned with margins that reach the nearest
cuts at least `margin` characters (the largest context window) beyond its core, so that contexts, and the keyword
scores read from them, are those of the whole text. Start offsets are shifted by the segment's place, and
locations, which are written from the offset, are written again.

Cuts are sought once per block of `size` characters (the first pair of whitespace characters at or after the block's
start), so a text is cut into pieces of about `size`; a text without such a pair is one segment, scanned whole.
The segments of one text are dealt over tasks by a hash of (row, segment), so one long text is scanned by many.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matches import location_label
from ..functions.patterns import SPACE
from .builtin import BUILTIN
from .scan import scan

# Two whitespace characters in a row: no match of a built-in detector crosses the place between them.
SEPARATOR = f"[{SPACE}][{SPACE}]"
SEGMENT_CHARS = 1 << 20


def cut_points(text: Column, size: int) -> Column:
    """Sorted 0-based places where the text may be cut, with 0 and its length."""
    length = F.length(text)
    blocks = F.ceil(length / F.lit(size)).cast("int")

    def first_pair(k: Column) -> Column:
        found = F.regexp_instr(F.substring(text, k * size + 1, size + 1), F.lit(SEPARATOR))
        return F.when(found > 0, k * size + found)

    inner = F.when(blocks > 1, F.filter(F.transform(F.sequence(F.lit(1), blocks - 1), first_pair), lambda c: c.isNotNull()))
    inner = F.coalesce(inner, F.array().cast("array<int>"))
    cuts = F.concat(F.array(F.lit(0)), inner, F.array(length))
    return F.array_distinct(F.filter(cuts, lambda c: c <= length))


def segments(df: DataFrame, text_col: str, size: int, margin: int) -> DataFrame:
    """One row per segment: the row's columns, the segment's text in `text_col`, and `_base`, `_from`, `_to`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in df.columns if c != text_col]
    cut = df.select(*others, text.alias("_whole"), cut_points(text, size).alias("_cuts"))
    cut = cut.select("*", F.posexplode(F.slice("_cuts", 1, F.greatest(F.size("_cuts") - 1, F.lit(1)))).alias("_seg", "_core"))
    core_end = F.coalesce(F.get(F.col("_cuts"), F.col("_seg") + 1), F.length("_whole"))
    left = F.coalesce(F.array_max(F.filter("_cuts", lambda c: c <= F.col("_core") - margin)), F.lit(0))
    right = F.coalesce(F.array_min(F.filter("_cuts", lambda c: c >= core_end + margin)), F.length("_whole"))
    placed = cut.select("*", core_end.alias("_end"), left.alias("_base"), right.alias("_stop"))
    return placed.select(
        *others,
        F.substring("_whole", F.col("_base") + 1, F.col("_stop") - F.col("_base")).alias(text_col),
        "_seg",
        "_base",
        (F.col("_core") - F.col("_base")).alias("_from"),
        (F.col("_end") - F.col("_base")).alias("_to"),
    )


def scan_segments(
    df: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id", "file_path"),
    detectors: Sequence[str] | None = None,
    size: int = SEGMENT_CHARS,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of `scan(df, text_col, keep, detectors)`, with each text scanned in segments of about `size` characters.

    Only the built-in detectors are taken (by name, or all of them): the cuts are proven for their patterns only.
    A null text has no findings, like an empty one.
    """
    chosen = [d for d in BUILTIN if not detectors or d.name.lower() in {n.lower() for n in detectors}]
    if detectors and not chosen:
        raise ValueError(f"no built-in detector among {list(detectors)}")
    margin = max(d.window for d in chosen)
    keep = list(keep)
    rows = segments(df.select(*dict.fromkeys([*keep, text_col])), text_col, size, margin)
    spread = F.xxhash64(*[F.col(c) for c in keep], F.col("_seg"))
    rows = rows.repartition(partitions, spread) if partitions else rows.repartition(spread)
    found = scan(rows, text_col, keep=[*keep, "_base", "_from", "_to"], detectors=chosen)
    owned = found.where((F.col("start_pos") >= F.col("_from")) & (F.col("start_pos") < F.col("_to")))
    start = (F.col("start_pos") + F.col("_base")).cast(found.schema["start_pos"].dataType)
    columns = [c for c in found.columns if c not in ("_base", "_from", "_to")]
    fixed = {
        "start_pos": start.alias("start_pos"),
        "location": F.when(F.col("location").isNotNull(), location_label(start)).alias("location"),
    }
    return owned.select(*[fixed.get(c, F.col(c)) for c in columns])
