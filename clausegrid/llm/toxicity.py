"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to two rows of one embedding table and their vectors added, so that two
words share a vector only if both rows collide. Filters of several widths slide over a
text's vectors; each filter's maximum over the whole text feeds a logistic output. The
training sample is bounded (SAMPLE rows of a class, SAMPLE_BYTES of their whole texts in all),
whatever the lengths of its texts; scoring reads every text whole. A verdict threshold is
chosen for each language from the out-of-fold scores of all labelled rows; the score itself
knows nothing but the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, id_mod, utf8
from .decontaminate import words

#: Labelled rows of each class that training takes at most, chosen by the hash of their id.
SAMPLE = 4000
#: Bytes of text of each class that training takes at most: rows are taken in the same order while they fit in; only a
#: text that is larger by itself cannot be one of them.
SAMPLE_BYTES = 1 << 25
ROWS, WIDTH, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 4, 64, 0.05
#: Toxic calibration rows that a language needs for a threshold of its own.
LEAST_TOXIC = 40
#: Thresholds to choose from.
GRID = np.arange(0.3, 0.9, 0.02)
#: Share of truly toxic rows among those that a threshold rejects.
PRECISION = 0.9
#: Calibration scores each row with a model that has not seen it: this many models.
FOLDS = 3
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000

_PAD = max(WIDTHS) - 1


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 9)
        return h


_hashes = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    own = words(text)
    return np.array(list(map(_hashes.__getitem__, own)), dtype=np.uint64)


def _lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind each other, each followed by padding (row ROWS: zeros): both rows of every word; text starts."""
    size = np.array([len(t) + _PAD for t in texts], dtype=np.int64)
    starts = np.cumsum(size) - size
    a, b = np.full(size.sum() + _PAD, ROWS, dtype=np.int32), np.full(size.sum() + _PAD, ROWS, dtype=np.int32)
    for s, t in zip(starts, texts):
        a[s:s + len(t)] = t % np.uint64(ROWS)
        b[s:s + len(t)] = (t >> np.uint64(32)) % np.uint64(ROWS)
    return a, b, starts


class Model:
    """Embedding table, filters by width, output weights; ``a``, ``b``: the calibrated logistic scale."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((ROWS + 1, WIDTH), dtype=np.float32)
        self.filters = [(rng.normal(0, 0.2, (k, WIDTH, FILTERS)) / k).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {}
        self.default = 0.3
        self.constant: float | None = None

    def maps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        e = self.table[a] + self.table[b]
        n = len(e) - _PAD
        return e, [sum(e[j:j + n] @ f[j] for j in range(len(f))) + c for f, c in zip(self.filters, self.bias)]

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        a, b, starts = _lay_out(texts)
        _, maps = self.maps(a, b)
        top = np.concatenate([np.maximum.reduceat(m, starts, axis=0) for m in maps], axis=1)
        return np.maximum(top, 0).astype(np.float64) @ self.out + self.out_bias

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -60, 60)))


def _start(model: Model, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
    """Begins the first column of the table as the rows' shrunk log odds of standing in a toxic text."""
    found = []
    for side in (0, 32):
        df = np.zeros((2, ROWS))
        for t, label in zip(texts, y):
            df[int(label)][np.unique((t >> np.uint64(side)) % np.uint64(ROWS)).astype(np.int64)] += 1
        found.append(df)
    df = found[0] + found[1]
    n = df.sum(axis=0)
    odds = np.log((df[1] + 0.5) / (2 * y.sum() + 1)) - np.log((df[0] + 0.5) / (2 * (1 - y).sum() + 1))
    seen = n > 0
    model.table[:ROWS][seen] = rng.normal(0, 0.05, (seen.sum(), WIDTH))
    model.table[:ROWS, 0] = np.where(seen, 0.5 * np.clip(odds * n / (n + 10), -4, 4), 0)
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, 0, 0] = 1
    model.out[0] = 1


def train(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Model:
    """Adagrad on the weighted logistic loss; gradients pass through each filter's best place only."""
    model, rng = Model(seed), np.random.default_rng(seed)
    _start(model, texts, y, rng)
    sums = {id(p): np.full(p.shape, 1e-3, dtype=np.float32) for p in (model.table, *model.filters, *model.bias, model.out)}
    bias_sum = 1e-3

    def step(p, g):
        s = sums[id(p)]
        s += g * g
        p -= RATE * g / np.sqrt(s)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            own = order[k:k + BATCH]
            a, b, starts = _lay_out([texts[i] for i in own])
            e, maps = model.maps(a, b)
            ends = np.r_[starts[1:], len(maps[0])]
            best = [np.stack([s + m[s:t].argmax(axis=0) for s, t in zip(starts, ends)]) for m in maps]
            top = np.concatenate([np.take_along_axis(m, p, axis=0) for m, p in zip(maps, best)], axis=1)
            act = np.maximum(top, 0)
            z = act @ model.out + model.out_bias
            d = ((1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)).astype(np.float32)
            g_top = d[:, None] * model.out * (top > 0)
            g_out = act.T @ d
            rows, grads = [], []
            for w, (f, c, p) in enumerate(zip(model.filters, model.bias, best)):
                g = g_top[:, w * FILTERS:(w + 1) * FILTERS]
                g_f = np.stack([np.einsum("df,dfe->ef", g, e[p + j]) for j in range(len(f))])
                for j in range(len(f)):
                    at, ge = (p + j).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, WIDTH)
                    rows += [a[at], b[at]]
                    grads += [ge, ge]
                step(f, g_f)
                step(c, g.sum(axis=0))
            step(model.out, g_out)
            bias_sum += float(d.sum()) ** 2
            model.out_bias -= np.float32(RATE * d.sum() / bias_sum**0.5)
            row, grad = np.concatenate(rows), np.concatenate(grads)
            live = row < ROWS
            hit, where = np.unique(row[live], return_inverse=True)
            g = np.zeros((len(hit), WIDTH), dtype=np.float32)
            np.add.at(g, where, grad[live])
            s = sums[id(model.table)]
            s[hit] += g * g
            model.table[hit] -= RATE * g / np.sqrt(s[hit])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list) -> None:
    """From logits of rows that their model had not seen: Platt's scale (with his smoothed targets), and thresholds
    of these rows; ``fit`` replaces them by those of all labelled rows."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - target) * z).sum() + 0.1 * (a - 1), (weight * (p - target)).sum()])
        r = weight * p * (1 - p)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a - np.clip(da, -0.5, 0.5), 0.05, 20)), b - float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-6:
            break
    model.scale, model.shift = a, b
    set_thresholds(model, zip(langs, y.astype(int), score_bins(model, z), np.ones(len(z), dtype=np.int64)))


def score_bins(model: Model, z: np.ndarray) -> np.ndarray:
    """How many thresholds of GRID the score of each logit reaches."""
    return np.searchsorted(GRID, 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -60, 60))), side="right")


def set_thresholds(model: Model, counts) -> None:
    """counts: (lang, toxic, bin, n) of labelled rows, unweighted."""
    by_lang: dict[str | None, np.ndarray] = {}
    for lang, toxic, k, n in counts:
        by_lang.setdefault(lang, np.zeros((2, len(GRID) + 1), dtype=np.int64))[toxic, k] += n
    model.default = _threshold(sum(by_lang.values(), np.zeros((2, len(GRID) + 1), dtype=np.int64)))
    model.thresholds = {lang: _threshold(n) for lang, n in by_lang.items() if n[1].sum() >= LEAST_TOXIC}


def _threshold(n: np.ndarray) -> float:
    """The least threshold, from 0.3 on, at which PRECISION of what is rejected is toxic, one clean row added for
    caution; 0.9 if there is none. n: rows by label and bin."""
    clean, toxic = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    good = np.flatnonzero(toxic >= PRECISION * (toxic + clean + 1))
    return float(GRID[good[0]]) if len(good) else 0.9


def _by_fold(models: list[Model], fold: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The ``score_bins`` of each text by the model of its fold."""
    got = np.empty(len(texts), dtype=np.int32)
    for f, m in enumerate(models):
        of = np.flatnonzero(fold == f)
        got[of] = score_bins(m, m.logits([texts[i] for i in of]))
    return got


def _counts(bins: DataFrame, marks: DataFrame) -> list[tuple]:
    """(lang, toxic, bin, n) over all labelled rows of (doc_id, lang, bin); no text is moved to its label."""
    return [tuple(r) for r in bins.join(marks, "doc_id").groupBy("lang", "toxic", "bin").count().collect()]


def _labelled_bins(docs: DataFrame, marks: DataFrame, models: list[Model]) -> list[tuple]:
    """(lang, toxic, bin, n) over all labelled rows, each scored by the model of its fold, which has not seen it."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select("doc_id", "lang", _fold().alias("fold"), "text").where(id_mod("doc_id", 4) != 2)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("bin", T.IntegerType())])

    def run(batches):
        for b in batches:
            fold = b.column("fold").to_numpy()
            bins = [_by_fold(held.value, fold[part], texts) for part, texts in _some(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(np.concatenate(bins))], names=schema.names)

    return _counts(rows.mapInArrow(run, schema), marks)


def _fold():
    return F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(0)).cast("int")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``train_model`` with thresholds by language from all labelled rows outside the held-out fold."""
    model, unseen, marks = train_model(docs, labels)
    if unseen:
        set_thresholds(model, _labelled_bins(docs, marks, unseen))
    return model


def train_model(docs: DataFrame, labels: DataFrame) -> tuple[Model, list[Model], DataFrame]:
    """(model, the models that have not seen each fold, labels) from labelled rows outside the held-out fold (crc32 of
    the id as text mod 4 is 2).

    A document with several labels counts as toxic if one says so. Null ids and marks are left out; a null text has no
    words; rows that repeat an id are trained on once and counted for thresholds each. Without
    rows of both classes the model is a constant: the share of toxic labels, shrunk to 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = (labels.where("doc_id is not null and toxic is not null").where(id_mod("doc_id", 4) != 2)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = marks.where("toxic = 0").orderBy(key, "doc_id").limit(SAMPLE).unionByName(marks.where("toxic = 1").orderBy(key, "doc_id").limit(SAMPLE))
    # 2 * SAMPLE ids at most, here and in what follows
    sized = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(key, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sized.where(F.col("size") <= SAMPLE_BYTES).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "toxic")
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(fitting), "doc_id")

    def run(batches):
        for b in batches:
            ids = [word_hashes(t).tobytes() for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("toxic"), pa.array(ids, pa.binary())], names=["doc_id", "lang", "toxic", "ids"])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("toxic", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    got = sample.mapInArrow(run, schema).dropDuplicates(["doc_id"]).withColumn("fold", _fold()).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").toArrow()
    y = np.array(got.column("toxic").to_pylist(), dtype=np.float64)
    fold = np.array(got.column("fold").to_pylist(), dtype=np.int64)
    if any(len(set(y[fold != k])) < 2 for k in range(FOLDS)):
        model = Model()
        model.constant = n.get(1, 0) / (sum(n.values()) + 20)
        model.default = 0.9
        return model, [], marks
    texts = [np.frombuffer(x, dtype=np.uint64) for x in got.column("ids").to_pylist()]
    share = n[1] / (n[0] + n[1])  # the sample's classes are weighted back to their share of all labels
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    some = lambda keep: [t for t, k in zip(texts, keep) if k]
    z = np.empty(len(texts))
    unseen = [train(some(fold != k), y[fold != k], np.sqrt(weight[fold != k])) for k in range(FOLDS)]
    for k, m in enumerate(unseen):
        z[fold == k] = m.logits(some(fold == k))
    model = train(texts, y, np.sqrt(weight))
    calibrate(model, z, y, weight, got.column("lang").to_pylist())
    for m in unseen:
        m.scale, m.shift = model.scale, model.shift
    return model, unseen, marks


def _some(b: pa.RecordBatch):
    """(rows, their texts' words) of a batch, some texts at a time: 2^17 words, or one text; once for an empty batch."""
    texts, size, at = [], 0, 0
    for t in utf8(b.column(b.schema.names.index("text"))):
        texts.append(word_hashes(t))
        size += len(texts[-1])
        if size > 1 << 17:
            yield slice(at, at + len(texts)), texts
            at, texts, size = at + len(texts), [], 0
    if texts or not at:
        yield slice(at, at + len(texts)), texts


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.3), toxic (score >= its language's threshold).

    A null or empty text is scored as a text without words. A null id counts as the empty string for the fold. Each
    row gives one row; other columns are not looked at.
    """
    model, unseen, marks = train_model(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model, unseen))
    narrow = docs.select("doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "lang", _fold().alias("fold"), "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("held_out", T.BooleanType()), narrow.schema["lang"], T.StructField("score", T.DoubleType()), T.StructField("bin", T.IntegerType())])

    def run(batches):
        model, unseen = held.value
        for b in batches:
            fold, scores, bins = b.column("fold").to_numpy(), [], []
            for part, texts in _some(b):
                scores.append(model.scores(texts))
                bins.append(_by_fold(unseen, fold[part], texts) if unseen else np.zeros(len(texts), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("lang"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(bins))], names=schema.names)

    scored = cut(narrow.mapInArrow(run, schema), "toxicity")  # one pass over the texts
    if unseen:
        set_thresholds(model, _counts(scored.where("not held_out").select("doc_id", "lang", "bin"), marks))
    bound = F.lit(model.default)
    for lang, least in model.thresholds.items():
        bound = F.when(F.col("lang").eqNullSafe(F.lit(lang)), least).otherwise(bound)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), (F.col("score") >= bound).alias("toxic"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below their language's threshold, with all their columns.

    Nulls, empty texts and repeated rows are treated as in ``score``; null languages are one of their own. Without labels
    of both classes nothing is rejected; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        m = model.value
        for b in batches:
            bound = np.array([m.thresholds.get(x, m.default) for x in b.column(b.schema.names.index("lang")).to_pylist()])
            yield b.filter(pa.array(np.concatenate([m.scores(texts) for _, texts in _some(b)]) < bound))

    return docs.mapInArrow(run, docs.schema)
