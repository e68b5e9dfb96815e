"""Packing of token sequences by patterns of lengths fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``limit`` numbers, whatever the corpus) is
planned with: all patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares,
rounded within what the histogram still holds, and the residual pieces packed best-fit
over counts of equal lengths. The plan says for each length which ranks go where; pieces
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import bounded_batches, cut

#: Tokens of a sequence.
LIMIT = 2048
#: Steps of the non-negative least squares fit.
STEPS = 150


def enumerate_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of occurring lengths (0: no piece) with sum ``limit``."""
    there = np.zeros(limit + 1, dtype=bool)
    there[lengths] = True
    there[0] = True
    own = np.flatnonzero(there)[::-1]
    out = []
    for a in own:
        if 3 * a < limit:
            break
        b = own[(own <= a) & (own <= limit - a)]
        c = limit - a - b
        fits = (c <= b) & there[c]
        out.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit_counts(patterns: np.ndarray, have: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of (pieces used - pieces there), each length
    weighted by its size, by accelerated projected gradient steps."""
    size = len(have)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0.0
    target = have * weight

    def used(x):
        return weight * sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))

    def back(r):
        r = r * weight
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    probe = np.ones(len(patterns))
    for _ in range(12):  # largest eigenvalue of the normal equations: the step that is safe
        probe = back(used(probe))
        top = np.linalg.norm(probe)
        probe /= top or 1.0
    step = 1.0 / max(top, 1e-12) / 1.05
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, z - step * back(used(z) - target))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def round_counts(repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole counts): the counts' running sum is rounded, so that neighbours with the same
    longest length keep their total to within one even where each count is a fraction."""
    whole = np.diff(np.floor(np.cumsum(repeat) + 0.5), prepend=0.0).astype(np.int64)
    some = np.flatnonzero(whole)
    order = np.argsort(-whole[some], kind="stable")
    return some[order], whole[some][order]


def plan(have: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, longest first; how many such sequences) for a histogram ``have`` (index: length)."""
    left = have.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns(np.flatnonzero(left), limit)
    if len(patterns):
        repeat = fit_counts(patterns, left.astype(float))
        for k, whole in zip(*round_counts(repeat)):
            own = tuple(int(v) for v in patterns[k] if v)
            need = Counter(own)
            n = min([int(whole), *(int(left[v]) // m for v, m in need.items())])
            if n > 0:
                out.append((own, n))
                for v, m in need.items():
                    left[v] -= m * n
    out += pack_residual(left, limit)
    return out


def pack_residual(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are opened and filled together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, space: int) -> None:
        if space:
            room[space][pattern] += n
        else:
            done.append((pattern, n))

    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s in room if s >= length and room[s]), default=None)
            if space is None:
                each = limit // length
                if n >= each:  # as many of them as one sequence holds
                    put((length,) * each, n // each, limit - each * length)
                    n %= each
                else:
                    put((length,) * n, 1, limit - n * length)
                    n = 0
                continue
            pattern = next(iter(room[space]))
            had = room[space].pop(pattern)
            if not room[space]:
                del room[space]
            each = min(space // length, n)
            take = min(had, n // each)
            put(pattern + (length,) * each, take, space - each * length)
            if had > take:
                room[space][pattern] += had - take
            n -= take * each
    for space in sorted(room):
        done += list(room[space].items())
    return done


def lookup(patterns: list[tuple[tuple[int, ...], int]], limit: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs, the sequence that the run's first rank gets, and its offset there."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for own, n in patterns:
        offset = 0
        for v in own:
            out[v].append((rank[v], base, offset))
            rank[v] += n
            offset += v
        base += n
    return {v: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for v, rows in out.items()}


def tokenize(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, and (chunk, rank): the rank among the pieces of
    equal length in the task that made them.

    A document's ids are its text's (null: none) and ``end_id``; longer ones are cut into pieces of ``limit``,
    of which the first takes the remainder.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("chunk", T.LongType()), ("rank", T.LongType())))])
    stop = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own, chunk = encoder(path), TaskContext.get().partitionId()
        met: dict[int, int] = defaultdict(int)
        for b in batches:
            take, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                raw = own.ids(text or "").tobytes() + stop
                total = len(raw) // 4
                at = 0
                while at < total:
                    n = (total - 1) % limit + 1 if at == 0 else limit
                    take.append(k)
                    piece.append(0 if at == 0 else piece[-1] + 1)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(memoryview(raw)[4 * at:4 * (at + n)]))
                    rank.append(met[n])
                    met[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(take), chunk, dtype=np.int64)), pa.array(rank, pa.int64())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of the end id alone. Repeated rows are packed each; an empty table gives
    an empty result. Other columns of ``docs`` are not looked at. ``path``: a ``tokenizers`` file.
    """
    spark = docs.sparkSession
    pieces = cut(tokenize(docs, path, limit, end_id), "pieces")
    met = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = cut(met.select("chunk", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before")), "piece-counts")
    have = np.zeros(limit + 1, dtype=np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        have[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(lookup(plan(have, limit), limit))  # bounded by the number of patterns, not of pieces
    ranked = pieces.join(before.select("chunk", "length", "before"), ["chunk", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        table = places.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                here = np.flatnonzero(length == v)
                first, base, offset = table[int(v)]
                run = np.searchsorted(first, rank[here], "right") - 1
                seq[here] = base[run] + rank[here] - first[run]
                off[here] = offset[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(place, schema)
