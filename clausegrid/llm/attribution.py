"""Token counts of the parts of a document, from one encoding of the whole.

Encoding parts on their own miscounts tokens where parts meet, so a document is encoded
once and each token's character span is joined to the spans of the parts.

The rule for a token that touches several parts: it belongs to the one with its first
character that lies in any part. A token that touches no part (a separator) is counted
on the row of the rest, part -1. Thus a document's counts always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import bounded_batches

#: Text to the (starts, ends) of its parts: ordered, disjoint, in characters; empty parts are allowed.
Parts = Callable[[str], tuple[np.ndarray, np.ndarray]]


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The parts between line feeds; an empty text is one empty line."""
    size = np.array([len(x) for x in text.split("\n")], dtype=np.int64)
    starts = np.cumsum(size + 1) - size - 1
    return starts, starts + size


def allocate(starts: np.ndarray, ends: np.ndarray, tok_from: np.ndarray, tok_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the part that it belongs to (-1: none), and whether it reaches beyond that part."""
    solid = np.flatnonzero(ends > starts)
    if not len(solid) or not len(tok_from):
        return np.full(len(tok_from), -1, dtype=np.int64), np.zeros(len(tok_from), dtype=bool)
    k = np.searchsorted(ends[solid], tok_from, "right")  # the first part that ends behind the token's first character
    part = solid[np.minimum(k, len(solid) - 1)]
    touches = (k < len(solid)) & (starts[part] < tok_to)
    crosses = touches & ((tok_from < starts[part]) | (tok_to > ends[part]))
    return np.where(touches, part, -1), crosses


def part_counts(docs: DataFrame, path: str, parts: Parts = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and part: id, part (from 0; -1 for the rest), start, length (characters), n_tokens, n_crossing.

    n_crossing: those of n_tokens that reach beyond the part. A null text is an empty one. The row of the rest is
    there only if it counts a token. Repeated rows are counted each. Other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = T.StructField(id_col, narrow.schema["id"].dataType, True)
    schema = T.StructType([id_field, *(T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("n_tokens", T.LongType()), ("n_crossing", T.LongType())))])

    def run(batches):
        own = encoder(path)
        for b in batches:
            take, cols = [], [[], [], [], [], []]
            for k, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                starts, ends = parts(text)
                tok_from, tok_to = own.spans(text)
                part, crosses = allocate(starts, ends, tok_from, tok_to)
                n = np.bincount(part + 1, minlength=len(starts) + 1)
                over = np.bincount(part[crosses] + 1, minlength=len(starts) + 1)
                rest = n[0] > 0
                take.append(np.full(len(starts) + rest, k))
                for c, x, r in zip(cols, (np.arange(len(starts)), starts, ends - starts, n[1:], over[1:]), (-1, 0, 0, n[0], 0)):
                    c.append(np.r_[x, r] if rest else x)
            if take:
                flat = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(pa.array(np.concatenate(take))), pa.array(flat[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in flat[1:])], names=schema.names)

    return narrow.mapInArrow(run, schema)


def line_counts(docs: DataFrame, path: str) -> DataFrame:
    """``part_counts`` of the lines of doc_id and text. An empty or null text is one empty line; repeated rows give their lines
    each; an empty table gives none; other columns are not looked at."""
    return part_counts(docs, path, lines)


def field_counts(docs: DataFrame, fields: list[str], path: str, separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """Per document and field: id, field, n_tokens, n_crossing, of the fields joined by ``separator`` and encoded once. Null fields
    are empty ones; repeated rows give a row a field each; an empty table gives none.

    Null fields are empty. Separator tokens are counted under field null.
    """
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    joined = docs.select(
        F.struct(F.col(id_col).alias("id"), F.array(*(F.char_length(v) for v in values)).alias("sizes")).alias("k"),
        F.concat(*(x for v in values for x in (v, F.lit(separator)))).alias("text"))
    bounded_batches(docs.sparkSession)
    gap = len(separator)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("field", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())])
    flat = joined.select(F.col("k.id").alias("id"), F.col("k.sizes").alias("sizes"), F.expr(f"substring(text, 1, char_length(text) - {gap})").alias("text"))

    def run(batches):
        own = encoder(path)
        for b in batches:
            take, names, n_all, over_all = [], [], [], []
            for k, (text, sizes) in enumerate(zip(b.column("text").to_pylist(), b.column("sizes").to_pylist())):
                size = np.array(sizes, dtype=np.int64)
                starts = np.cumsum(size + gap) - size - gap
                tok_from, tok_to = own.spans(text or "")
                part, crosses = allocate(starts, starts + size, tok_from, tok_to)
                n = np.bincount(part + 1, minlength=len(fields) + 1)
                over = np.bincount(part[crosses] + 1, minlength=len(fields) + 1)
                first = 0 if n[0] else 1
                take += [k] * (len(fields) + 1 - first)
                names += [None, *fields][first:]
                n_all += n[first:].tolist()
                over_all += over[first:].tolist()
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(take, pa.int64())), pa.array(names, pa.string()), pa.array(n_all, pa.int64()), pa.array(over_all, pa.int64())], names=schema.names)

    return flat.mapInArrow(run, schema)
