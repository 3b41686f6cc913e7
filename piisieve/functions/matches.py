"""Every match of a pattern with its offset, and the text around it."""

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import exclusive_sums, let

# Texts longer than this are cut into blocks once, so that slicing near the end does not walk the text
# from its start for every hit.
LONG_TEXT = 65536
TEXT_BLOCK = 1024

HITS_TYPE = "array<struct<value:string,start:int>>"

# Up to this many matches of a text are located by plain search.
FEW_MATCHES = 8


def whole_matches(text: Column, pattern: str) -> Column:
    """All non-overlapping leftmost matches of `pattern`, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def start_offsets(text: Column, pattern: Column, wholes: Column) -> Column:
    """0-based offset of each match in `wholes`, in characters.

    A few matches, each of which occurs once in the text as a string, are found by plain search. Else
    the text is split by the pattern that found the matches, and the offsets follow by adding up the
    lengths of matches and pieces; a search could stop at an equal string that is no match.
    """
    def added_up(gaps: Column) -> Column:
        before = exclusive_sums(F.zip_with(gaps, wholes, lambda gap, w: gap + F.length(w)))
        return F.zip_with(before, gaps, lambda n, gap: n + gap)

    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(wholes))
    return F.coalesce(searched_offsets(text, wholes), let(F.transform(pieces, F.length), added_up))


def searched_offsets(text: Column, values: Column) -> Column:
    """0-based offset of each value by plain search; NULL for many values, or if one stands in the text twice or is empty."""

    def once(places: Column) -> Column:
        again = F.zip_with(values, places, lambda v, place: F.position(v, text, place + 2))
        return F.when(F.forall(again, lambda place: place == 0), places)

    return F.when(F.size(values) <= FEW_MATCHES, let(F.transform(values, lambda v: F.position(v, text) - 1), once))


def one_or_two(values: Column) -> Column:
    return F.size(values).between(1, 2)


def first_places(text: Column, values: Column) -> tuple[Column, Column]:
    """1-based places where the first and the second of at most two values first stand in the text; else NULL."""
    n = F.size(values)
    return (
        F.when(one_or_two(values), F.position(F.get(values, F.lit(0)), text)),
        F.when(n == 2, F.position(F.get(values, F.lit(1)), text)),
    )


def unique_offsets(text: Column, values: Column, first: Column, second: Column) -> Column:
    """`searched_offsets` of one or two values from their `first_places`, as generated code; NULL for any other number.

    Most texts with a match hold one or two, and lambdas, which are interpreted, cost more there than the search itself.
    """

    def once(place: Column, at: int) -> Column:
        return F.position(F.get(values, F.lit(at)), text, place + 1) == 0

    n = F.size(values)
    return F.when((n == 1) & once(first, 0), F.array(first - 1)).when(
        (n == 2) & once(first, 0) & once(second, 1), F.array(first - 1, second - 1)
    )


def split_offsets(text: Column, pattern: str, wholes: Column) -> Column:
    """0-based offsets of one or two whole matches from the pieces around them; NULL for any other number."""

    def before(pieces: Column) -> Column:
        start = F.length(F.get(pieces, F.lit(0)))
        after = start + F.length(F.get(wholes, F.lit(0))) + F.length(F.get(pieces, F.lit(1)))
        return F.when(F.size(wholes) == 1, F.array(start)).otherwise(F.array(start, after))

    return F.when(one_or_two(wholes), let(F.split(text, pattern, -1), before))


def ends_with_group(pattern: str) -> bool:
    """Whether the pattern's first group, which must be one that can be placed, is the last thing it matches."""
    return not around_group(pattern)[3]


def group_offsets(text: Column, pattern: str, values: Column) -> Column:
    """0-based offset of the group of each match, for a pattern that ends with it; `values` are the groups' texts.

    The groups themselves are searched, so the pattern only runs again for the matches around them where that fails.
    """

    def ends(wholes: Column) -> Column:
        starts = start_offsets(text, F.lit(pattern), wholes)
        lengths = F.zip_with(wholes, values, lambda w, v: F.length(w) - F.length(v))
        return F.zip_with(starts, lengths, lambda start, before: start + before)

    return F.coalesce(searched_offsets(text, values), let(whole_matches(text, pattern), ends))


def hits_at(text: Column, pattern: str, wholes: Column, starts: Column, group: int = 0) -> Column:
    """`array<struct<value, start>>` of the matches.

    With `group` = 1 the value is that group; a match in which it is empty or takes no part is no hit then,
    unless the pattern ends with it. See `around_group` for the patterns that are taken.
    """
    if group == 0:
        return F.arrays_zip(wholes.alias("value"), starts.alias("start")).cast(HITS_TYPE)

    flags, prefix, inner, rest = around_group(pattern)
    if not rest:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            lambda value, i: F.struct(
                value.alias("value"),
                (F.get(starts, i) + F.length(F.get(wholes, i)) - F.length(value)).alias("start"),
            ),
        )
    # What stands before the group becomes a group of its own, whose length places it.
    wrapped = F.lit(f"{flags}({prefix}){inner}{rest}")

    def placed(befores: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, wrapped, F.lit(2)),
            lambda value, i: F.struct(
                value.alias("value"), (F.get(starts, i) + F.length(F.get(befores, i))).alias("start")
            ),
        )

    return F.filter(
        let(F.regexp_extract_all(text, wrapped, F.lit(1)), placed), lambda hit: F.length(hit["value"]) > 0
    )


def matches_empty(pattern: str) -> bool:
    """Whether a pattern matches an empty text, as far as Python's `re` can read it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return re.search(pattern, "") is not None
        except re.error:
            return False


def around_group(pattern: str) -> tuple[str, str, str, str]:
    """Leading flags, what stands before the first group, the group with its brackets, and what follows.

    The group must stand outside other brackets and alternatives, must not be repeated, and the pattern must
    not refer back to groups or set flags further on; any other pattern raises a ValueError.
    """
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", pattern)[0]
    body = pattern[len(flags) :]
    depth = in_class = i = 0
    opened = closed = None
    plain = True
    while i < len(body):
        c = body[i]
        if body.startswith("\\Q", i):
            end = body.find("\\E", i)
            i = len(body) if end < 0 else end + 2
            continue
        if c == "\\":
            plain &= body[i + 1 : i + 2] not in tuple("123456789k")
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif in_class:
            pass
        elif c == "(":
            plain &= re.match(r"\(\?[a-zA-Z-]+\)", body[i:]) is None
            captures = not body.startswith("(?", i) or re.match(r"\(\?<[a-zA-Z]", body[i:])
            if captures and opened is None:
                opened = i
                plain &= depth == 0
            depth += 1
        elif c == ")":
            depth -= 1
            if opened is not None and closed is None and depth == 0:
                closed = i + 1
        elif c == "|":
            plain &= depth > 0
        i += 1
    if closed is None or not plain or body[closed : closed + 1] in ("*", "+", "{"):
        raise ValueError(f"the first group of this pattern cannot be placed: {pattern}")
    return flags, body[:opened], body[opened:closed], body[closed:]


def find_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches with offsets in one expression, for use outside a scan."""

    def located(wholes: Column) -> Column:
        return let(
            start_offsets(text, F.lit(pattern), wholes),
            lambda starts: hits_at(text, pattern, wholes, starts, group),
        )

    return let(
        whole_matches(text, pattern),
        lambda wholes: F.when(F.size(wholes) > 0, located(wholes)).otherwise(
            F.array().cast(HITS_TYPE)
        ),
    )


def text_blocks(text: Column) -> Column:
    """The text in pieces of TEXT_BLOCK characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def slice_text(text: Column, blocks: Column | None, start: Column, length: Column) -> Column:
    """`length` characters from 0-based `start`; reads only the blocks concerned where they are given."""
    direct = F.substring(text, start + 1, length)
    if blocks is None:
        return direct
    first = F.floor(start / TEXT_BLOCK).cast("int")
    count = F.floor((start + length) / TEXT_BLOCK).cast("int") - first + 1
    near = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.when(blocks.isNull(), direct).otherwise(
        F.substring(near, start - first * TEXT_BLOCK + 1, length)
    )


def context_window(
    text: Column, start: Column, length: Column, window: int | Column, blocks: Column | None = None
) -> Column:
    """The match with up to `window` characters on each side."""
    begin = F.greatest(start - window, F.lit(0))
    return slice_text(text, blocks, begin, start + length + window - begin)


def location_label(start: Column) -> Column:
    """Fixed wording of a finding's place."""
    return F.concat(F.lit("附近 (char ~"), start.cast("string"), F.lit(")"))
