"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before). Both factors are softmaxes
over sums of weight rows chosen by hashed features of the words before: the previous word,
the two before as an n-gram, and skips to the second and third word before. The most frequent
words have weights of their own (a square number of them: classes of as many slots); all other
words fall into classes by their endings and share their class's mass by their smoothed counts,
so that the model gives every word, seen or not, a probability. Weighted words and hashed rows
grow with the cube root of the vocabulary, which on the given documents more than holds the
share of tokens that are weighted.

Counts cover all training texts. Words of large count go to every worker, up to HEAD of
them; what the others add is found by a join, so no table that grows with the corpus is
ever broadcast or collected. Texts become word numbers once; training and scoring read
those. Training starts from the unigram model, and each document takes part in one of
ROUNDS rounds, in one share of it: a share takes gradient steps on a copy of the weights,
and the rows of the weight table are averaged by how many words each share saw of them.
Shares are chosen by hashes of the documents and are as many as their tokens ask for, so
the model does not depend on the cluster or on how the table is stored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, id_mod, utf8

#: Classes, and slots of a class, of the smallest model, which serves LEAST_WORDS distinct words; classes by endings.
SIDE, LEAST_WORDS, ENDINGS = 32, 1 << 17, 16
#: Most words that are sent to every worker with their counts.
HEAD = 1 << 17
ROUNDS, STEP, BATCH, DAMP = 2, 0.6, 1 << 12, 6.0
#: The token behind a text's last word; no word can hold white space.
END = b"\n"
SMOOTH = 0.1
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000

#: Hashed rows of each feature in the smallest class table and word table; row 0 (and one row a class) is the bias.
_CLASS_ROWS = (1 << 14, 1 << 14, 1 << 13, 1 << 13)
_WORD_ROWS = (1 << 14, 1 << 13)
#: Numbers that a table holds at most, so that a worker can hold its own copy.
_NUMBERS = 1 << 25
_BLOCK = 1024


def ending_class(word: bytes) -> int:
    """Which of the classes behind the others a word without weights is in: by a hash of its last bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


def side_of(distinct: int) -> int:
    """Classes, and slots of each, for so many distinct words: their product grows as the words' cube root."""
    side = SIDE * (max(distinct, LEAST_WORDS) / LEAST_WORDS) ** (1 / 6)
    return min(round(side), int(HEAD**0.5))


def _starts(bias: int, rows: tuple[int, ...], side: int, width: int) -> np.ndarray:
    """Where each feature's rows begin, and where the last end: as many times the smallest table's as words are weighted."""
    times = min((side / SIDE) ** 2, _NUMBERS / width / sum(rows))
    return np.cumsum((bias, *(int(n * times) for n in rows)))


class _Index(dict):
    """Word to its place among the head words; other words, which are noted, to len(head) plus the number of their ending."""

    head = 0

    def __init__(self, words):
        super().__init__(words)
        self.noted: list[bytes] = []

    def __missing__(self, word):
        self.noted.append(word)
        return self.head + ending_class(word)


class Vocabulary:
    """What every worker knows of the counts: head words, class masses and totals."""

    def __init__(self, words: list[bytes], counts: list[int], mass: dict[int, tuple[int, int]], total: int, distinct: int):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.words = [words[k] for k in order]
        self.total, self.distinct = total, distinct
        c = np.array([counts[k] for k in order], dtype=np.float64)
        h = len(c)
        self.classes = self.slots = side = side_of(distinct)
        self.class_at = _starts(1, _CLASS_ROWS, side, side + ENDINGS)
        self.word_at = _starts(side, _WORD_ROWS, side, side)
        width = side + ENDINGS
        self.log_count = np.log10(c + SMOOTH)
        # class, slot (-1: none) of head words, then of words known by their ending only
        own = min(h, side * side)
        self.cls = np.array([k % side if k < own else side + ending_class(w) for k, w in enumerate(self.words)] + list(range(side, width)), dtype=np.int32)
        self.slot = np.array([k // side if k < own else -1 for k in range(h)] + [-1] * ENDINGS, dtype=np.int32)
        n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for k, (tokens, types) in mass.items():
            n[k], v[k] = tokens, types
        for k in range(own):  # words with weights leave the mass of their ending's class
            e = ending_class(self.words[k])
            n[e] -= c[k]
            v[e] -= 1
        z = n + SMOOTH * (v + 1)
        self.log_mass = np.r_[np.zeros(side), np.log10(z)]
        prior = np.zeros(width)
        np.add.at(prior, self.cls[:own], c[:own] + SMOOTH)
        prior[side:] = z
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(prior / prior.sum()), -1e4).astype(np.float32)
            word = np.zeros((side, side))
            word[self.cls[:own], self.slot[:own]] = c[:own] + SMOOTH
            self.word_bias = np.maximum(np.log(word / np.maximum(word.sum(axis=1, keepdims=True), 1e-9)), -1e4).astype(np.float32)
        self.denominator = np.log10(total + SMOOTH * (distinct + 1))

    def index(self) -> _Index:
        out = _Index((w, k) for k, w in enumerate(self.words))
        out.head = len(self.words)
        return out

    def weights(self) -> list[np.ndarray]:
        """The unigram model: biases alone."""
        c = np.zeros((self.class_at[-1], self.classes + ENDINGS), dtype=np.float32)
        w = np.zeros((self.word_at[-1], self.slots), dtype=np.float32)
        c[0], w[:self.classes] = self.class_bias, self.word_bias
        return [c, w]


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _spread(mixed: np.ndarray, n: int, start: int) -> np.ndarray:
    """Numbers of 44 bits to n rows (under 2^20) from ``start`` on, by a product in place of a remainder."""
    return (mixed * np.uint64(n) >> np.uint64(44)).astype(np.int64) + start


def contexts(ids: np.ndarray, first: np.ndarray, lo: int = 0, hi: int | None = None) -> list[np.ndarray]:
    """The words one, two and three before each of the tokens lo to hi; 0 before a text's first. first: texts' starts."""
    at = np.arange(lo, len(ids) if hi is None else min(hi, len(ids)))
    begin = first[np.searchsorted(first, at, "right") - 1]
    return [np.where(at - k >= begin, ids[np.maximum(at - k, 0)].astype(np.int64) + 1, 0) for k in (1, 2, 3)]


def class_rows(before: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    one, two, three = before
    keys = (_mix(one, 1), _mix(one * (1 << 20) + two, 2), _mix(two, 3), _mix(three, 4))
    return [_spread(k, n, s) for k, n, s in zip(keys, np.diff(at), at)]


def word_rows(before: list[np.ndarray], cls: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    keys = (_mix(before[0] * 512 + cls, 5), _mix(before[1] * 512 + cls, 6))
    return [cls.astype(np.int64), *(_spread(k, n, s) for k, n, s in zip(keys, np.diff(at), at))]


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp(z), its sums by row) up to a factor a row, which z is shifted by where it has to be; sums are products with ones."""
    ones = np.ones(z.shape[1], dtype=np.float32)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ ones
    if not 1e-30 < total.min() <= total.max() < 1e38:
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e @ ones
    return e, total


def _sum_rows(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray | None = None) -> np.ndarray:
    out = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(table, r, axis=0)
    if bias is not None:
        out += bias
    return out


def _order(r: np.ndarray) -> np.ndarray:
    """Stable order of row numbers, sorted as 16-bit numbers: numpy's radix sort."""
    r = r - r.min()
    low = np.argsort(r.astype(np.uint16), kind="stable")
    return low if r.max() < 1 << 16 else low[np.argsort((r[low] >> 16).astype(np.uint16), kind="stable")]


#: Members of a row's group that are added one after the other for all groups at once; the rest of large groups is reduced.
_ABREAST = 3


def _sum_groups(grad: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of grad[order] over each group: places first to first + n."""
    out = np.take(grad, order[first], axis=0)
    for k in range(1, _ABREAST):
        more = np.flatnonzero(n > k)
        out[more] += np.take(grad, order[first[more] + k], axis=0)
    large = np.flatnonzero(n > _ABREAST)
    if len(large):
        rest = n[large] - _ABREAST
        begin = np.cumsum(rest) - rest
        at = np.arange(rest.sum()) + np.repeat(first[large] + _ABREAST - begin, rest)
        own = np.take(grad, order[at], axis=0)
        if own.shape[1] % 2 == 0:  # two numbers a step
            out[large] += np.add.reduceat(own.view(np.complex64), begin, axis=0).view(np.float32)
        else:
            out[large] += np.add.reduceat(own, begin, axis=0)
    return out


def _climb(table: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], grad: np.ndarray) -> None:
    """Moves each row along its mean gradient, less for rows met seldom."""
    for r in rows:
        order = _order(r)
        s = r[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        n = np.diff(first, append=len(s))
        out = _sum_groups(grad, order, first, n)
        n = n.astype(np.float32)
        out *= (np.float32(STEP) / (n + np.float32(DAMP)))[:, None]
        own = s[first]
        out += np.take(table, own, axis=0)
        table[own] = out
        seen[own] += n


def _gradient(z: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Of the log likelihood by the logits: one for the true one, less every one's probability."""
    grad, total = _exponentials(z)
    grad *= (np.float32(-1) / total)[:, None]
    grad[np.arange(len(grad)), true] += 1
    return grad


def _log_probability(z: np.ndarray, true: np.ndarray) -> np.ndarray:
    total = _exponentials(z)[1]  # may shift z
    return z[np.arange(len(z)), true] - np.log(total)


def train_on(weights: list[np.ndarray], seen: list[np.ndarray], voc: Vocabulary, ids: np.ndarray, first: np.ndarray) -> None:
    """Gradient steps on the tokens, BATCH at a time, in place."""
    c, w = weights
    cls, slot = voc.cls[ids], voc.slot[ids]
    for k in range(0, len(ids), BATCH):
        part = slice(k, k + BATCH)
        own = contexts(ids, first, k, k + BATCH)
        rows = class_rows(own, voc.class_at)
        grad = _gradient(_sum_rows(c, rows, c[0]), cls[part])
        _climb(c, seen[0], rows, grad)
        c[0] += STEP * (np.ones(len(grad), dtype=np.float32) @ grad) / (len(grad) + DAMP)
        seen[0][0] += len(grad)
        weighted = np.flatnonzero(slot[part] >= 0)
        if len(weighted):
            rows = word_rows([b[weighted] for b in own], cls[part][weighted], voc.word_at)
            grad = _gradient(_sum_rows(w, rows), slot[part][weighted])
            _climb(w, seen[1], rows, grad)


def log10_model(weights: list[np.ndarray], voc: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per token: log10 of its class and, in it, of its weighted word or of one count unit in its ending's mass."""
    c, w = weights
    out = np.empty(len(ids))
    cls, slot = voc.cls[ids], voc.slot[ids]
    for k in range(0, len(ids), BATCH):
        part = slice(k, k + BATCH)
        own = contexts(ids, first, k, k + BATCH)
        lp = _log_probability(_sum_rows(c, class_rows(own, voc.class_at), c[0]), cls[part]).astype(np.float64)
        weighted = np.flatnonzero(slot[part] >= 0)
        if len(weighted):
            lp[weighted] += _log_probability(_sum_rows(w, word_rows([b[weighted] for b in own], cls[part][weighted], voc.word_at)), slot[part][weighted])
        out[part] = lp / np.log(10) - voc.log_mass[cls[part]]
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts of ``docs``, the END of each included. Tasks sum before they send."""
    bounded_batches(docs.sparkSession)

    def flush(held: Counter):
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([ending_class(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "ending", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            texts = utf8(b.column("text"))
            for t in texts:
                held.update(t.lower().split())
                if len(held) > HELD_WORDS:
                    yield flush(held)
                    held = Counter()
            held[END] += len(texts)
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(run, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The head words and the class masses of a count table; the count from which on words are in the head."""
    level = F.floor(F.log2("n") * 64)
    levels = sorted(((r["level"], r["words"], r["least"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    least, taken = (1 << 62), 0
    for _, words, low in levels:  # a few thousand levels at any size
        if taken + words > head:
            break
        taken, least = taken + words, low
    mass = {r["ending"]: (r["tokens"], r["types"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect()}
    top = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    voc = Vocabulary(top.column("word").to_pylist(), top.column("n").to_pylist(), mass, sum(a for a, _ in mass.values()), sum(b for _, b in mass.values()))
    return voc, least


def packed(ids: np.ndarray) -> bytes:
    """Numbers below 2^24 as their lower 16 bits, then their upper 8 bits, most of which are equal."""
    return ids.astype(np.uint16).tobytes() + (ids >> 16).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 3
    return np.frombuffer(raw, dtype=np.uint16, count=n).astype(np.int32) | np.frombuffer(raw, dtype=np.uint8, offset=2 * n).astype(np.int32) << 16


def encode(rows: DataFrame, known, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows``, ids (numbers of the tokens, ``packed``), and the words outside the head with their counts.

    known: the broadcast Vocabulary. A null text has the END alone."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches):
        index = known.value.index()
        end_known, get, end = END in index, index.__getitem__, index[END]
        index.noted.clear()
        for b in batches:
            numbers, rare, times, upto = [], [], array("i"), array("i", [0])
            for t in utf8(b.column("text")):
                ids = array("i", map(get, t.lower().split()))
                ids.append(end)
                if not end_known:
                    index.noted.append(END)
                own = Counter(index.noted)
                index.noted.clear()
                numbers.append(packed(np.frombuffer(ids, dtype=np.int32)))
                rare.extend(own)
                times.extend(own.values())
                upto.append(len(rare))
            at = pa.array(upto, pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(rare, pa.binary()), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(numbers, pa.binary()), *lists], names=schema.names)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def _texts_at_a_time(column: pa.Array, tokens: int = 1 << 17):
    """(ids of many texts, where each begins), some texts at a time: up to so many tokens, or one text."""
    held, size = [], 0
    for x in column.to_pylist():
        ids = unpacked(x)
        if held and size + len(ids) > tokens:
            yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])


_MOVES = pa.schema([("side", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("moved", pa.binary()), ("seen", pa.binary())])
#: Shares whose moves of a block are merged in one group; more are merged in two steps.
_MERGED = 64


def train(texts: DataFrame, voc: Vocabulary, known) -> list[np.ndarray]:
    """The weights after ROUNDS rounds; ``texts``: key (a hash that spreads the documents), ids. ``known``: voc, broadcast.

    A share has about as many tokens as the tables have numbers: what shares send is in proportion to what they read."""
    spark = texts.sparkSession
    weights = voc.weights()
    shares = max(1, -(-voc.total // (ROUNDS * sum(w.size for w in weights))))
    parts = -(-shares // _MERGED)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Mean of the moves, weighted by how many words each share saw of a row."""
        seen = [np.frombuffer(x, dtype=np.float32) for x in pdf.seen]
        total = np.sum(seen, axis=0)
        moved = sum(np.frombuffer(x, dtype=np.float16).astype(np.float32).reshape(len(n), -1) * n[:, None] for x, n in zip(pdf.moved, seen))
        mean = (moved / np.maximum(total, 1)[:, None]).astype(np.float16)
        return pd.DataFrame({"side": [key[0]], "block": [key[1]], "part": [0], "moved": [mean.tobytes()], "seen": [total.tobytes()]})

    form = "side int, block int, part int, moved binary, seen binary"
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast(weights)

        def run(batches):
            voc, begun = known.value, held.value
            share = own = seen = None

            def moves():
                for side, (w, was, n) in enumerate(zip(own, begun, seen)):
                    for at in range(0, len(w), _BLOCK):
                        part = slice(at, at + _BLOCK)
                        if n[part].any():
                            moved = (w[part] - was[part]).astype(np.float16)
                            yield pa.RecordBatch.from_pylist([{"side": side, "block": at // _BLOCK, "part": share % parts, "moved": moved.tobytes(), "seen": n[part].tobytes()}], schema=_MOVES)

            for b in batches:
                at = b.column("share").to_numpy()
                edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
                for lo, hi in zip(edges, edges[1:]):
                    if lo == hi:
                        continue
                    if share != at[lo]:
                        if share is not None:
                            yield from moves()
                        share, own, seen = int(at[lo]), [w.copy() for w in begun], [np.zeros(len(w), dtype=np.float32) for w in begun]
                    for ids, first in _texts_at_a_time(b.column("ids").slice(lo, hi - lo)):
                        train_on(own, seen, voc, ids, first)
            if share is not None:
                yield from moves()

        turn = texts.where(F.pmod("key", F.lit(ROUNDS)) == k).select(F.pmod(F.shiftright("key", 8), F.lit(shares)).cast("int").alias("share"), "key", "ids")
        dealt = turn.repartitionById(shares, F.col("share")).sortWithinPartitions("share", "key", "ids").select("share", "ids")
        moves = dealt.mapInArrow(run, form)
        if parts > 1:
            moves = moves.groupBy("side", "block", "part").applyInPandas(merge, form)
        for r in moves.groupBy("side", "block").applyInPandas(merge, form).toLocalIterator():  # one weight table, a part at a time
            moved = np.frombuffer(r["moved"], dtype=np.float16).astype(np.float32)
            own = weights[r["side"]][r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK]
            own += moved.reshape(own.shape)
        held.destroy()  # the driver's copy too
    return weights


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs``: doc_id, text (null: empty; one END token). Rows whose crc32 of the id as text mod 10 is 0 are held
    out of counting and training; a null id counts as the empty string. base_score: smoothed unigram; score: the
    model's log10 probability. Each row gives one row, repeated ids included; other columns are not looked at. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select("doc_id", (id_mod("doc_id", 10) == 0).alias("held_out"), "text")
    counts = cut(count_words(narrow.where("not held_out").select("text")), "word-counts")
    voc, least = vocabulary(counts, head)
    known = spark.sparkContext.broadcast(voc)
    # copies of a text are dealt to different shares by their ids
    rows = narrow.withColumns({"row": F.monotonically_increasing_id(), "key": F.xxhash64(F.col("doc_id").cast("string"), "text")})
    texts = cut(encode(rows, known, ["row", "doc_id", "held_out", "key"]), "lm-texts")
    weights = spark.sparkContext.broadcast(train(texts.where("not held_out").select("key", "ids"), voc, known))
    fields = [("row", T.LongType()), ("doc_id", narrow.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_head", T.LongType()),
              ("base", T.DoubleType()), ("model", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        voc = known.value
        h = len(voc.words)
        log_count = np.append(voc.log_count, np.zeros(ENDINGS))
        for b in batches:
            out: dict[str, list] = {f: [] for f, _ in fields[3:]}
            for ids, first in _texts_at_a_time(b.column("ids")):
                lp = log10_model(weights.value, voc, ids, first)
                count_part = log_count[ids]
                lp += np.where(voc.slot[ids] < 0, count_part, 0.0)
                out["n_tokens"] += np.diff(first, append=len(ids)).tolist()
                out["n_head"] += np.add.reduceat((ids < h).astype(np.int64), first).tolist()
                out["base"] += np.add.reduceat(count_part, first).tolist()
                out["model"] += np.add.reduceat(lp, first).tolist()
            kinds = {"base": pa.float64(), "model": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), *(pa.array(v, kinds.get(f, pa.int64())) for f, v in out.items())], names=schema.names)

    scored = texts.select("row", "doc_id", "held_out", "ids").mapInArrow(run, schema)
    # what the rare words add: their counts are met by a join, where each word is one key of small count
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least).select("word", "n").hint("shuffle_hash"), "word", "left")  # words are spread evenly: no need to sort
    n = F.coalesce(F.col("n"), F.lit(0))
    added = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("added"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("met"))
    plus = F.coalesce("added", F.lit(0.0))
    return scored.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + plus - F.col("n_tokens") * float(voc.denominator)).alias("base_score"), (F.col("model") + plus).alias("score"))
