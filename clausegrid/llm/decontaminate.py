"""Benchmark decontamination with word-level suffix arrays of the training documents.

Each task turns the documents of a batch (a shard) into one array of word numbers, sorts
the suffixes, and binary-searches every benchmark suffix that holds a window among them
(suffixes that begin with the same window together). All suffixes with the first words of
a window lie together, so the search gives every occurrence at once. Occurrences of an
item's neighbouring suffixes at neighbouring places are one match: these runs are the
longest verbatim matches, with their places.

The array is sparse: it leaves out suffixes that no benchmark suffix can meet, namely
those whose first words (three, or all of an item of fewer) begin no window. A document
lies in one shard, so nothing is shuffled and a passage that a third of all documents
share costs each shard its own part only.

The benchmark reaches the tasks in blocks of at most BLOCK_WORDS words, one broadcast a
block, each loaded in turn: a larger benchmark takes more blocks and not more memory.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, utf8

#: Words of the benchmark in one broadcast block; about 300 bytes each in a worker.
BLOCK_WORDS = 1 << 18
#: Words of documents in one suffix array.
SHARD_WORDS = 1 << 20

#: Bytes to words: A-Z lower-cased; digits, letters and all non-ASCII kept; the rest parts words.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class _Known(dict):
    """Word to number; a word of no item is 0."""

    def __missing__(self, word):
        return 0


#: Pairs of a place and a benchmark suffix that are joined to runs at a time.
PAIRS = 1 << 20


def make_block(items: list[tuple], window: int) -> dict:
    """The searchable form of some items: the windows that begin their suffixes, the items of each window, and where
    each window stands. An item: (name, words), or (name, words, place of the first word) for a piece of a longer one.

    Items with equal words are searched as one text. Texts stand behind each other with a gap, so a window's
    places in two texts never neighbour."""
    number = _Known()
    names: dict[tuple, set[str]] = {}
    for name, own, *start in items:
        ids = tuple(number.setdefault(w, len(number) + 1) for w in own)
        names.setdefault((ids, name, start[0]) if start else (ids, None, 0), set()).add(name)
    at: dict[tuple[int, ...], list[int]] = {}
    of: dict[tuple[int, ...], set[int]] = {}
    begin, size, texts = [], [], 0
    for u, (ids, _, _) in enumerate(names):
        m = min(window, len(ids))
        begin.append(texts)
        size.append(m)
        for k in range(len(ids) - m + 1):
            at.setdefault(ids[k:k + m], []).append(texts + k)
            of.setdefault(ids[k:k + m], set()).add(u)
        texts += len(ids) - m + 2
    keys, own = list(at), [sorted(n) for n in names.values()]
    rank = {n: k for k, n in enumerate(sorted({n[0] for n in own}))}
    return {
        "words": dict(number), "keys": keys, "sizes": np.array([len(k) for k in keys], dtype=np.int64), "window": window,
        "items": [sorted({n for u in of[k] for n in own[u]}) for k in keys],
        "heads": {n: _heads(np.array(sorted({k[:n] for k in keys if min(3, len(k)) == n}), dtype=np.int64).reshape(-1, n)) for n in (1, 2, 3)},
        "places": np.array([j for k in keys for j in at[k]], dtype=np.int64), "offsets": np.cumsum([0, *(len(at[k]) for k in keys)]),
        "begin": np.array([*begin, texts], dtype=np.int64), "text_window": np.array(size, dtype=np.int64), "least": [n[0] for n in own],
        "rank": np.array([rank[n[0]] for n in own], dtype=np.int64), "piece": [None if name is None else (name, start) for _, name, start in names]}


def _pack(columns) -> np.ndarray:
    """Word numbers (under 2^21) of up to three places as one key."""
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        key = (key << 21) | c
    return key


def _heads(rows: np.ndarray) -> np.ndarray:
    return np.unique(_pack(list(rows.T))) if len(rows) else np.zeros(0, dtype=np.int64)


def suffix_array(ids: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that can match, in order of their first ``window`` words; those words as bytes."""
    depth = block["window"]
    found = []
    for p, heads in block["heads"].items():
        n = len(ids) - p + 1
        if n <= 0 or not len(heads):
            continue
        live = ids[:n] > 0
        for k in range(1, p):
            live &= ids[k:n + k] > 0
        at = np.flatnonzero(live)
        key = _pack([ids[at + k] for k in range(p)])
        found.append(at[heads[np.minimum(np.searchsorted(heads, key), len(heads) - 1)] == key])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=f"S{4 * depth}")
    at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    first = _as_bytes(padded[at[:, None] + np.arange(depth)], depth)
    order = np.argsort(first, kind="stable")
    return at[order], first[order]


def _as_bytes(rows: np.ndarray, depth: int) -> np.ndarray:
    """Rows of word numbers as strings that sort like the rows; shorter rows are padded below all numbers."""
    wide = np.zeros((len(rows), depth), dtype=">u4")
    wide[:, :rows.shape[1]] = rows
    return np.ascontiguousarray(wide).view(f"S{4 * depth}").ravel()


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 and so on, n numbers of each, behind each other."""
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def find_windows(places: np.ndarray, first: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of every window, by two binary searches each."""
    if not len(places):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    depth = block["window"]
    lo, hi = np.searchsorted(first, _as_bytes_of(block, depth, 0), "left"), np.searchsorted(first, _as_bytes_of(block, depth, 0xFFFFFFFF), "right")
    n = np.maximum(hi - lo, 0)
    return places[_ranges(lo, n)], np.repeat(np.arange(len(n)), n)


def _as_bytes_of(block: dict, depth: int, fill: int) -> np.ndarray:
    name = f"as_bytes_{fill}"
    if name not in block:
        wide = np.full((len(block["keys"]), depth), fill, dtype=">u4")
        for k, key in enumerate(block["keys"]):
            wide[k, :len(key)] = key
        block[name] = np.ascontiguousarray(wide).view(f"S{4 * depth}").ravel()
    return block[name]


def match_runs(place: np.ndarray, key: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, the window's place in the block, windows) of each maximal run: neighbouring windows of a text at
    neighbouring places. PAIRS at a time; a run that goes on is carried over, and may be given cut short as well."""
    order = np.argsort(place, kind="stable")
    place, key = place[order], key[order]
    lo, n = block["offsets"][key], block["offsets"][key + 1] - block["offsets"][key]
    edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, dtype=np.int64)
    upto = np.cumsum(n)
    out: list[tuple[np.ndarray, ...]] = []
    carried: dict[int, int] = {}
    at, last = 0, -2
    while at < len(place):
        # all pairs of some whole places: PAIRS, or one place's
        room = np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")
        stop = edges[np.searchsorted(edges, room, "right") - 1] if room < len(place) else len(place)
        if stop <= at:
            later = np.searchsorted(edges, at, "right")
            stop = edges[later] if later < len(edges) else len(place)
        part = slice(at, stop)
        a, j = np.repeat(place[part], n[part]), block["places"][_ranges(lo[part], n[part])]
        by = np.lexsort((a, a - j))
        a, j = a[by], j[by]
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(a - j) != 0) | (np.diff(a) != 1))))
        run = np.diff(begin, append=len(a))
        a, j = a[begin], j[begin]
        if carried and place[at] == last + 1:
            for k in np.flatnonzero(a == last + 1):
                before = carried.get(int(a[k] - j[k]), 0)
                a[k], j[k], run[k] = a[k] - before, j[k] - before, run[k] + before
        last = int(place[stop - 1])
        carried = {int(a[k] - j[k]): int(run[k]) for k in np.flatnonzero(a + run - 1 == last)} if stop < len(place) else {}
        out.append((a, j, run))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (place, place, place)


def _better(old: tuple | None, new: tuple) -> tuple:
    """Of matches (words, place, item): the longest, then the first, then that of the least item."""
    return new if old is None or (-new[0], *new[1:]) < (-old[0], *old[1:]) else old


def _longest(place, key, block: dict, starts: np.ndarray, best: list, pieces: dict) -> None:
    """Betters each text's longest match by the runs of this block; runs that may go on in another piece of an item are added to ``pieces``."""
    a, j, run = match_runs(place, key, block)
    if not len(a):
        return
    text = np.searchsorted(block["begin"], j, "right") - 1
    doc = np.searchsorted(starts, a, "right") - 1
    size, at = run + block["text_window"][text] - 1, a - starts[doc]
    order = np.lexsort((block["rank"][text], at, -size, doc))
    for k in order[np.flatnonzero(np.concatenate(([True], np.diff(doc[order]) != 0)))]:
        best[doc[k]] = _better(best[doc[k]], (int(size[k]), int(at[k]), block["least"][text[k]]))
    for u, piece in enumerate(block["piece"]):
        if piece is not None:
            first, last = block["begin"][u], block["begin"][u + 1] - 2
            for k in np.flatnonzero((text == u) & ((j == first) | (j + run - 1 == last))):
                key = (int(doc[k]), piece[0], int(at[k] - (j[k] - first) - piece[1]))
                pieces.setdefault(key, {})[int(at[k])] = max(int(run[k]), pieces.get(key, {}).get(int(at[k]), 0))


def search_shard(texts: list[list[bytes]], blocks, longest: bool = False):
    """(hit, items, matches): for each text a mask of hit words, its items, and its longest match with an item as (words,
    first word, item), of a window's words at least (None without one, or unless ``longest`` is asked for)."""
    ends = list(accumulate(len(t) + 1 for t in texts))
    starts = np.array([0, *ends[:-1]], dtype=np.int64)
    total = ends[-1] if ends else 0
    edge = np.zeros(total + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in texts]
    best: list[tuple | None] = [None] * len(texts)
    pieces: dict[tuple, dict[int, int]] = {}
    window = 0
    for block in blocks:
        window = block["window"]
        get = _Known(block["words"]).__getitem__
        ids = np.zeros(total, dtype=np.int32)
        for s, t in zip(starts, texts):
            ids[s:s + len(t)] = list(map(get, t))
        place, key = find_windows(*suffix_array(ids, block), block)
        if not len(place):
            continue
        np.add.at(edge, place, 1)
        np.add.at(edge, place + block["sizes"][key], -1)
        for pair in np.unique((np.searchsorted(starts, place, "right") - 1) * len(block["keys"]) + key).tolist():
            d, k = divmod(pair, len(block["keys"]))
            items[d].update(block["items"][k])
        if longest:
            _longest(place, key, block, starts, best, pieces)
    for (d, name, _), runs in pieces.items():  # runs on one diagonal of one item, piece by piece
        begin = upto = -1
        for at in sorted(runs):
            begin = begin if at == upto else at
            upto = max(upto, at + runs[at])
            best[d] = _better(best[d], (upto - begin + window - 1, begin, name))
    hit = np.cumsum(edge[:total]) > 0
    return [hit[s:s + len(t)] for s, t in zip(starts, texts)], items, best


def broadcast_benchmark(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark's items in broadcast blocks. A null or word-less text has no window; a null item_id is ''."""
    spark = benchmark.sparkSession
    block_words = max(block_words, 2 * window)
    out, held, size = [], [], 0

    def close():
        nonlocal held, size
        if held:
            out.append(spark.sparkContext.broadcast(make_block(held, window)))
        held, size = [], 0

    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        own = words(bytes(row["t"] or b""))
        # a long item is searched in overlapping pieces: every window lies in one of them
        pieces = [(k, own[k:k + block_words]) for k in range(0, max(1, len(own) - window + 1), max(1, block_words - window + 1))]
        for start, piece in pieces if own else []:
            if size + len(piece) > block_words:
                close()
            held.append((row["i"], piece, start) if len(pieces) > 1 else (row["i"], piece))
            size += len(piece)
    close()
    return out


def _loaded(blocks):
    for b in blocks:
        yield b.value
        if len(blocks) > 1:  # one block in memory at a time
            b.__dict__.pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item.

    longest: words of the longest verbatim match with an item, if that is a window or more (0: none); longest_at: its
    first word in the document, from 0; longest_item: its item. Ties: the first place, then the least item_id. A null or empty text has no words and no hits. Repeated rows give a row each. Items with
    equal texts all count. Items shorter than a window are a window themselves. With an empty
    benchmark nothing is hit; items_sha256 is then that of the empty string. Other columns of
    either table are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = broadcast_benchmark(benchmark, window, block_words)
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()),
        ("longest", T.LongType()), ("longest_at", T.LongType()), ("longest_item", T.StringType())))])

    def run(batches):
        for b in batches:
            texts = [words(x) for x in utf8(b.column("text"))]
            hit, items, best = [], [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SHARD_WORDS):
                    size += len(texts[end])
                    end += 1
                h, i, m = search_shard(texts[at:end], _loaded(blocks), longest=True)
                hit += [int(x.sum()) for x in h]
                items += i
                best += m
                at = end
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
                pa.array([m[0] if m else 0 for m in best], pa.int64()), pa.array([m[1] if m else None for m in best], pa.int64()),
                pa.array([m[2] if m else None for m in best], pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns.

    Nulls, empty texts, short items and repeated rows are treated as in ``contamination``; with an empty benchmark all
    rows stay, and an empty table stays empty. The whole rows pass through the search and clean ones come out: nothing is joined or shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = broadcast_benchmark(benchmark, window, block_words)

    def run(batches):
        for b in batches:
            texts = [words(x) for x in utf8(b.column(b.schema.names.index("text")))]
            keep, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SHARD_WORDS):
                    size += len(texts[end])
                    end += 1
                keep += [not h.any() for h in search_shard(texts[at:end], _loaded(blocks))[0]]
                at = end
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, row_number() OVER () AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, t, j, least(10, len(w)) AS m, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, t, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT r, k, dw.m, item_id, t, j FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS p FROM (SELECT DISTINCT r, k, m FROM hits)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r),
steps AS (SELECT *, k - row_number() OVER (PARTITION BY r, t, k - j ORDER BY k) AS run FROM hits),
runs AS (SELECT r, item_id, min(k) - 1 AS place, count(*) + m - 1 AS n FROM steps GROUP BY r, item_id, t, m, k - j, run),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, place, item_id) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n, 0) AS BIGINT) AS longest, CAST(place AS BIGINT) AS longest_at, best.item_id AS longest_item
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN it ON d.r = it.r LEFT JOIN best ON d.r = best.r
"""
