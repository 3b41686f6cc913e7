"""Small array helpers that keep per-row work close to linear in the array's length."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix sums are built in blocks of this many elements; see `exclusive_sums`.
SUM_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _growing_sums(numbers: Column) -> Column:
    """[0, n1, n1+n2, ...]: one more element than `numbers`. Quadratic, so for short arrays only."""
    return F.aggregate(
        numbers,
        F.array(F.lit(0)),
        lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)),
    )


def exclusive_sums(numbers: Column) -> Column:
    """Sum of all earlier elements, for each element of an integer array.

    A document may hold a million hits, so long arrays are summed in blocks: sums inside each
    block, sums over the block totals, and the two added. That costs n * SUM_BLOCK steps rather
    than n * n.
    """

    def in_blocks(values: Column) -> Column:
        block_starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(SUM_BLOCK))
        blocks = F.transform(block_starts, lambda at: F.slice(values, at + 1, F.lit(SUM_BLOCK)))
        return let(
            blocks,
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    F.slice(
                        _growing_sums(
                            F.transform(
                                parts, lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
                            )
                        ),
                        F.lit(1),
                        F.size(parts),
                    ),
                    lambda part, base: F.transform(
                        F.slice(_growing_sums(part), F.lit(1), F.size(part)), lambda s: s + base
                    ),
                )
            ),
        )

    return let(
        numbers,
        lambda values: F.when(
            F.size(values) <= SUM_BLOCK,
            F.slice(_growing_sums(values), F.lit(1), F.size(values)),
        ).otherwise(in_blocks(values)),
    )


def first_per_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Drop every item whose key equals that of the item before it; the array must be sorted by key."""
    return let(
        items,
        lambda all_items: F.filter(
            all_items,
            lambda item, i: (i == 0) | ~key(F.get(all_items, i - 1)).eqNullSafe(key(item)),
        ),
    )
