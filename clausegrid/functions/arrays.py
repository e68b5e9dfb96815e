"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are added up one by one; whole blocks before them are added as blocks.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_totals(sizes: Column) -> Column:
    """For each item the sum of those before it; null for null. Costs about BLOCK / 2 sums an item, at any length."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda acc, x: acc + x)

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))

    def within(s: Column, before: Column) -> Column:
        return F.transform(s, lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.slice(s, i - i % BLOCK + 1, i % BLOCK)))

    whole = lambda s: let(blocks(s), lambda own: let(F.transform(own, lambda _, b: total(F.slice(own, F.lit(1), b))), lambda before: within(s, before)))
    return let(sizes, lambda s: F.when(F.size(s) > 0, whole(s)).when(s.isNotNull(), none))
