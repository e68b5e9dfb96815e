"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform random permutation of N rows that lie in P partitions, cut into blocks of
given sizes, sends a multivariate hypergeometric number of rows from each partition to
each block. So: count the partitions, draw the P x B matrix of exact counts, permute
the rows of each partition and deal them out by its row of the matrix, exchange, and
permute each block. Blocks are the shards, cut further so that no task ever holds more
than ``block_rows`` rows, whatever a shard's size.

No one holds the matrix. Partition p's row is found by walking down a binary tree over
the partitions: every node splits its block counts between its two halves by a draw
seeded with (seed, node), so all tasks see the same matrix, and a task that is run
again deals its rows out as before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: numpy draws hypergeometric numbers from populations of up to this size.
_NUMPY_LIMIT = 10**9


def _draw_large(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One hypergeometric draw by inversion outward from the mode, for any population."""
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    log_p = (lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(sample - mode + 1)
             - lg(bad - sample + mode + 1) - lg(total + 1) + lg(sample + 1) + lg(total - sample + 1))
    left, u = mode - 1, rng.random()
    p_right, right = math.exp(log_p), mode
    p_left = p_right * mode * (bad - sample + mode) / max(1.0, float(good - mode + 1) * (sample - mode + 1))
    while True:
        if right <= high:
            u -= p_right
            if u <= 0:
                return right
            p_right *= float(good - right) * (sample - right) / (float(right + 1) * (bad - sample + right + 1))
            right += 1
        if left >= low:
            u -= p_left
            if u <= 0:
                return left
            p_left *= float(left) * (bad - sample + left) / (float(good - left + 1) * (sample - left + 1))
            left -= 1
        if (right > high and left < low) or (p_right == 0.0 and p_left == 0.0):
            return mode


def draw_counts(rng: np.random.Generator, room: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows, taken at random from blocks of ``room`` rows, are each block's."""
    if room.sum() < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(room, sample, method="marginals")
    out, rest = np.zeros_like(room), int(room.sum())
    for j, good in enumerate(map(int, room)):
        rest -= good
        if good and sample:
            take = sample if not rest else (
                int(rng.hypergeometric(good, rest, sample)) if good + rest < _NUMPY_LIMIT else _draw_large(rng, good, rest, sample))
            out[j], sample = take, sample - take
    return out


def matrix_row(starts: np.ndarray, sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row ``p`` of the communication matrix. starts: rows before each partition, with the total last."""
    low, high, node, room = 0, len(starts) - 1, 1, sizes.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw_counts(np.random.default_rng([seed, node]), room, int(starts[mid] - starts[low]))
        if p < mid:
            high, node, room = mid, 2 * node, left
        else:
            low, node, room = mid, 2 * node + 1, room - left
    return room


def block_sizes(total: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact (shard, first slot, rows) of every block; shards differ by one row at most."""
    shard, first, rows = [], [], []
    for s in range(shards):
        n = total // shards + (s < total % shards)
        parts = max(1, -(-n // block_rows))
        edges = [n * k // parts for k in range(parts + 1)]
        shard += [s] * parts
        first += edges[:-1]
        rows += [b - a for a, b in zip(edges, edges[1:])]
    return np.array(shard, dtype=np.int32), np.array(first, dtype=np.int64), np.array(rows, dtype=np.int64)


def uniform_shards(df: DataFrame, shards: int, seed: int = 7, block_rows: int = 1 << 16) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Every assignment of rows to slots is equally likely; shards have exact sizes that
    differ by one row at most. Rows are dealt out whatever they hold, so nulls, equal
    rows and empty texts are rows like others; an empty table gives an empty one.
    ``df`` may have any columns but ``__part``, ``__pos``, ``__block``; columns named
    ``shard`` or ``slot`` are replaced. ``block_rows`` bounds a task's rows in the last
    permutation.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    held = cut(df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__pos")), "shuffle")
    # one small row per partition: the only thing that the driver sees
    counts = sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(np.int64)
    total = int(starts[-1])
    shard, first, rows = block_sizes(total, shards, block_rows)
    order = spark.sparkContext.broadcast(({p: k for k, (p, _) in enumerate(counts)}, starts, rows))
    home = spark.sparkContext.broadcast((shard, first))

    def deal(part: int) -> np.ndarray:
        index, begun, size = order.value
        k = index[part]
        labels = np.repeat(np.arange(len(size), dtype=np.int32), matrix_row(begun, size, k, seed))
        np.random.default_rng([seed, 1, k]).shuffle(labels)
        return labels

    low_bits = (1 << 33) - 1  # of monotonically_increasing_id: the position in its partition

    def label(batches):
        dealt: dict[int, np.ndarray] = {}
        for b in batches:
            part = b.column("__part").to_numpy()
            pos = b.column("__pos").to_numpy() & low_bits
            out = np.empty(len(part), dtype=np.int32)
            for p in np.unique(part):
                if p not in dealt:
                    if len(dealt) >= 4:
                        dealt.clear()
                    dealt[int(p)] = deal(int(p))
                here = part == p
                out[here] = dealt[int(p)][pos[here]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "__block"])

    schema = T_add(held.schema, "__block", "int")
    blocks = len(rows)
    sent = held.mapInArrow(label, schema).repartition(max(1, min(blocks, spark_parts(spark, blocks))), "__block").sortWithinPartitions("__block", "__part", "__pos")

    def settle(batches):
        """Permutes each block: its rows arrive together, in a fixed order."""
        block, perm, at = None, None, 0
        for b in batches:
            own = b.column("__block").to_numpy()
            s, z = np.empty(len(own), dtype=np.int32), np.empty(len(own), dtype=np.int64)
            edges = np.flatnonzero(np.diff(own)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(own)]):
                if lo == hi:
                    continue
                if own[lo] != block:
                    block, at = int(own[lo]), 0
                    perm = np.random.default_rng([seed, 2, block]).permutation(int(order.value[2][block]))
                s[lo:hi] = home.value[0][block]
                z[lo:hi] = home.value[1][block] + perm[at:at + hi - lo]
                at += hi - lo
            keep = [n for n in b.schema.names if n not in ("__part", "__pos", "__block")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(s), pa.array(z)], names=[*keep, "shard", "slot"])

    out = T_add(T_add(df.schema, "shard", "int"), "slot", "long")
    return sent.mapInArrow(settle, out)


def T_add(schema, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T.LongType() if kind == "long" else T.IntegerType(), True)])


def spark_parts(spark, blocks: int) -> int:
    """Tasks of the exchange: the session's number, but not fewer than needed to hold few blocks each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Deals documents into shards under the law ``rows``: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32
    (of the UTF-8 bytes; null: of none, 0), law, shard, slot, grown_shard (null: only
    the law ``key`` has one). Equal texts are separate rows and may part: a uniform
    shuffle keeps no group together.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return uniform_shards(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
