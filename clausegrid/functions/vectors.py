"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a vector has no length; null if a vector is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it, inside lambdas too."""
    return F.transform(F.array(value), then)[0]


def normalise(a: Column) -> Column:
    return _once(F.sqrt(dot(a, a)), lambda norm: F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))


def hash_vector(text: Column, lanes: int = 32) -> Column:
    """A unit vector of two SHA-256 digests' 16-bit lanes: stands in for an embedding model in tests."""
    lane = lambda digits, i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
    signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v) / 32767.0
    all_lanes = lambda digits: F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: signed(lane(digits, i)))
    first = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return _once(_once(_once(first, lambda d: F.concat(d, F.sha2(F.unhex(d), 256))), all_lanes), normalise)
