"""Scores from keywords near a match, risk tiers and masking."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores of a match with a supporting keyword near it, and with an opposing one.
SUPPORTED_SCORE = 0.6
OPPOSED_SCORE = 0.4

# Upper bounds of the report's three highlighted tiers.
VERY_LOW_BELOW = 0.5
LOW_BELOW = 0.6
MEDIUM_BELOW = 0.8


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def keyword_score(
    context: Column,
    base: float,
    positive: Sequence[str],
    negative: Sequence[str],
    ignore_case: bool = False,
) -> Column:
    """Score by the words in the context; a supporting word outweighs an opposing one."""
    if ignore_case:
        context = F.lower(context)
        positive = [word.lower() for word in positive]
        negative = [word.lower() for word in negative]
    return (
        F.when(contains_any(context, positive), F.lit(SUPPORTED_SCORE))
        .when(contains_any(context, negative), F.lit(OPPOSED_SCORE))
        .otherwise(F.lit(float(base)))
    )


def risk_tier(score: Column) -> Column:
    """Tier of a score; scores from 0.8 up are not highlighted."""
    return (
        F.when(score < VERY_LOW_BELOW, F.lit("very_low"))
        .when(score < LOW_BELOW, F.lit("low"))
        .when(score < MEDIUM_BELOW, F.lit("medium"))
        .otherwise(F.lit("none"))
    )


def mask_value(value: Column) -> Column:
    """Keep the first and last quarter; values under four characters are hidden whole."""
    quarter = F.floor(F.length(value) / 4).cast("int")
    return F.when(F.length(value) < 4, F.lit("***")).otherwise(
        F.concat(F.left(value, quarter), F.lit("..."), F.right(value, quarter))
    )
