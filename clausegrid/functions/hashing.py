"""Content addresses: ``lr1:`` and the SHA-256 of UTF-8 text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "lr1:"
#: Ends every part of a composed address, the last one too.
UNIT = "\x1f"


def content_hash(text: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(text.cast("binary"), 256))


def address(*parts: str) -> str:
    """The composed address of literal parts, as ``compose`` makes it of columns."""
    return PREFIX + hashlib.sha256("".join(p + UNIT for p in parts).encode()).hexdigest()


def normalise_source(text: Column) -> Column:
    """Text sources are addressed without a byte order mark and with line feeds alone."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def compose(*parts: Column | str) -> Column:
    """Address of an ordered list of parts; null parts count as empty."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return content_hash(F.concat(*(x for c in cols for x in (c, F.lit(UNIT)))))


def compose_list(parts: Column) -> Column:
    """Address of an array of parts, in its order."""
    return content_hash(F.aggregate(parts, F.lit(""), lambda acc, p: F.concat(acc, F.coalesce(p, F.lit("")), F.lit(UNIT))))
