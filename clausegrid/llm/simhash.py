"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

Fingerprints that differ in d bits or fewer agree on at least m-d of m bit blocks, so
the upper nodes of the index are the choices of m-d blocks: a node holds the
fingerprints that share the masked bit pattern of its blocks. Inside a node the
fingerprints are sorted by Gray rank, where neighbours share most bits; runs of them
become leaves, and leaves become inner nodes, each of which keeps the bits on which all
its fingerprints agree. Two nodes are compared by the bits known in both: the
differences accumulated there prune the pair when they exceed d, and join the groups
whole when even all unknown bits could not. What a node finds leaves it as a spanning
star of each group, never as pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, utf8
from .graph import components

BITS = 64
LEAF = 32
FAN = 4
#: A node with more fingerprints is dealt into chunks of about this size, and every two
#: chunks are searched together; no task holds more than two chunks of one node.
NODE_ROWS = 1 << 14


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    step = 1 << 15
    for at in range(0, n, step):
        part = words[at:at + step + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        raw = b"".join([digest(g, 42) for g in grams])
        counts += np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long. A null text has none of the words: 0."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x) for x in utf8(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _unite(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j; lab always points at the least member."""
    while True:
        a, b = lab[i], lab[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := lab[lab], lab):
            lab[:] = nxt


def link_group(fps: np.ndarray, d: int) -> np.ndarray:
    """For distinct fingerprints of one node, in Gray order: the least index of each one's group."""
    n = len(fps)
    lab = np.arange(n)
    first = np.arange(0, n, LEAF)
    ands, ors = [np.bitwise_and.reduceat(fps, first)], [np.bitwise_or.reduceat(fps, first)]
    while len(ands[-1]) > 1:
        at = np.arange(0, len(ands[-1]), FAN)
        ands.append(np.bitwise_and.reduceat(ands[-1], at))
        ors.append(np.bitwise_or.reduceat(ors[-1], at))
    pad = np.full(len(first) * LEAF, fps[-1], dtype=np.uint64)
    pad[:n] = fps
    cells = pad.reshape(-1, LEAF)
    last = np.minimum(first + LEAF, n)
    stack = [(len(ands) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 4096:
            stack += [(level, a[k:k + 4096], b[k:k + 4096]) for k in range(0, len(a), 4096)]
            continue
        known = ~((ands[level][a] ^ ors[level][a]) | (ands[level][b] ^ ors[level][b]))
        low = np.bitwise_count((ands[level][a] ^ ands[level][b]) & known).astype(np.int16)
        near = low <= d
        whole = near & (low + (BITS - np.bitwise_count(known).astype(np.int16)) <= d)
        for x, y in zip(a[whole], b[whole]):
            span = LEAF * FAN**level
            members = np.r_[x * span:min(n, (x + 1) * span), y * span:min(n, (y + 1) * span)]
            _unite(lab, members, np.full(len(members), members[0]))
        a, b = a[near & ~whole], b[near & ~whole]
        if not len(a):
            continue
        if level:
            width = len(ands[level - 1])
            ca = (a[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            cb = (b[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            fits = (ca < width) & (cb < width) & (ca <= cb)
            stack.append((level - 1, ca[fits], cb[fits]))
            continue
        low_lab, high_lab = np.minimum.reduceat(lab, first), np.maximum.reduceat(lab, first)
        joined = (low_lab[a] == high_lab[a]) & (low_lab[b] == high_lab[b]) & (low_lab[a] == low_lab[b])
        a, b = a[~joined], b[~joined]
        for k in range(0, len(a), 1024):
            x, y = a[k:k + 1024], b[k:k + 1024]
            p, r, c = np.nonzero(np.bitwise_count(cells[x][:, :, None] ^ cells[y][:, None, :]) <= d)
            i, j = first[x[p]] + r, first[y[p]] + c
            real = (i < last[x[p]]) & (j < last[y[p]]) & (i < j)
            _unite(lab, i[real], j[real])
    return lab


def link_groups(group: np.ndarray, fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: (fingerprint, least-ranked fingerprint of its group), where they differ."""
    order = np.lexsort((gray_rank(fps), group))
    group, fps = group[order], fps[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    lab = np.arange(len(fps))
    small = np.repeat(sizes <= 2 * LEAF, sizes)
    if small.any():  # nodes of a leaf or two: all their pairs, side by side
        g, x, at = group[small], fps[small], np.flatnonzero(small)
        for k in range(1, int(sizes[sizes <= 2 * LEAF].max())):
            hit = np.flatnonzero((g[k:] == g[:-k]) & (np.bitwise_count(x[k:] ^ x[:-k]) <= d))
            if len(hit):
                _unite(lab, at[hit], at[hit + k])
    for s, n in zip(starts[sizes > 2 * LEAF], sizes[sizes > 2 * LEAF]):
        lab[s:s + n] = s + link_group(fps[s:s + n], d)
    off = lab != np.arange(len(lab))
    return fps[off], fps[lab[off]]


def _masks(d: int, n: int) -> list[int]:
    """Bit masks of the upper nodes: with m blocks, every choice of m-d; m so that a node
    of evenly spread fingerprints holds at most a few thousand of n."""
    m = d + 1
    while n / 2 ** (BITS * (m - d) / m) > 4096 and m < d + 3:
        m += 1
    edges = [BITS * k // m for k in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, m - d)]


def link_edges(distinct: DataFrame, d: int) -> DataFrame:
    """Spanning edges (u, v) of the links within distance d between distinct ``fp``."""
    spark = distinct.sparkSession
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in _masks(d, distinct.count())]
    nodes = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "pattern"))
    large = nodes.groupBy("t", "pattern").count().where(F.col("count") > NODE_ROWS).select(
        "t", "pattern", F.ceil(F.col("count") / NODE_ROWS).cast("int").alias("parts"))
    dealt = (nodes.join(large, ["t", "pattern"], "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("fp", "t", "pattern", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    keys = ["t", "pattern", "i", "j"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = dealt.repartition(width, *keys).sortWithinPartitions(*keys)

    def search(batches):
        rest = None
        for b in batches:
            part = pa.table([b.column(c) for c in ("fp", *keys)], names=["fp", *keys])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if len(rest) < 1 << 16:
                continue
            cols = [rest.column(c).to_numpy() for c in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if len(change):  # the last node may go on in the next batch
                yield from found(rest.slice(0, int(change[-1])))
                rest = rest.slice(int(change[-1]))
        if rest is not None and len(rest):
            yield from found(rest)

    def found(part):
        cols = [part.column(c).to_numpy() for c in keys]
        group = np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        u, v = link_groups(group, np.ascontiguousarray(part.column("fp").to_numpy()).view(np.uint64), d)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return sent.mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the least id reachable by links).

    One row for each row of ``docs``, repeated ids and null ids included; a null id gives
    way to any other in its component. Empty and null texts have fingerprint 0 and link
    like any other. Other columns of ``docs`` are not looked at.
    """
    held = cut(fingerprints(docs, id_col, text_col), "simhash")
    distinct = cut(held.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    stars = cut(components(link_edges(distinct, distance)).select(F.col("u").alias("fp"), F.col("v").alias("root")), "simhash-stars")
    members = cut(stars.unionByName(stars.select(F.col("root").alias("fp"), "root").distinct()).join(distinct.select("fp", "least"), "fp"), "simhash-members")
    groups = cut(members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-groups")
    linked = spread_join(members.select("fp", "root"), groups, "root", total[1]).select("fp", "component_id")
    named = cut(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    return spread_join(held, named, "fp", total[0]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each component, its first row stays.

    Nulls, empty texts, repeated rows and empty tables are treated as in ``near_duplicates``: rows without a word are one
    component. ``docs`` is read twice and has to give the same rows in the same order, as a table of files does."""
    name = "row"
    while name in docs.columns:
        name += "_"
    row = docs.withColumn(name, F.monotonically_increasing_id())
    first = near_duplicates(row, name, text_col, distance).where(F.col(name) == F.col("component_id")).select(name)
    return row.join(first, name, "left_semi").drop(name)
