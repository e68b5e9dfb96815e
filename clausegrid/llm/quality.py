"""Quality rules: base counts of a text, and robust multivariate outliers among documents."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, utf8

#: Names of the transformed statistics, in the order of the vectors.
STATISTICS = ("word_length", "symbols", "capitals", "punctuation", "stutter", "dup_lines", "repeats")
#: Longer texts have their repeated windows found with arrays instead of tuples.
ARRAY_WORDS = 50_000
#: Weight of the prior in each rate: so many words (or lines) at the rate 0 are added, so that
#: short texts do not get extreme rates from single characters.
PRIOR_WORDS, PRIOR_LINES = 20, 4
#: Sampling variance of each statistic in a text: this, over its words or its lines (both with their priors). A root of a
#: rate varies by a quarter of what one event counts; a repeat counts two windows of five words at least; the lengths
#: of words vary by about half their mean.
NOISE = ((0.25, "words"), (0.25, "words"), (0.25, "words"), (0.25, "words"), (0.25, "words"), (0.25, "lines"), (2.5, "words"))

_SPACE = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_POINTS = b"!?\"'()+-/:;=@[\\]^_`{}~"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that are found twice or more in the text, first findings included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n > ARRAY_WORDS:
        return _repeated_long(words, window)
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    out, covered = 0, 0
    for k, g in enumerate(grams):
        if count[g] > 1:
            out += k + window - max(covered, k)
            covered = k + window
    return out


def _repeated_long(words: list[bytes], window: int) -> int:
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    name = ids
    for k in range(1, window):  # windows of k+1 words named by (window of k words, next word)
        name = np.unique(name[:len(ids) - k] * len(number) + ids[k:], return_inverse=True)[1]
    often = np.bincount(name)[name] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:len(often)] += often
    edge[window:] -= often
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int, list[float], int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, transformed statistics, lines with a word)."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, [0.0] * len(STATISTICS), 0
    chars = len(text.translate(None, _SPACE + _TAILS))
    without = lambda drop: len(text) - len(text.translate(None, drop))
    symbols = without(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    rate = lambda k: float(np.sqrt(k / (n + PRIOR_WORDS)))
    stats = [
        float(np.log((chars + 5.0 * PRIOR_WORDS) / (n + PRIOR_WORDS))), rate(symbols), rate(without(_UPPER)), rate(without(_POINTS)), rate(sum(map(eq, words, words[1:]))),
        float(np.sqrt(dup / (len(lines) + PRIOR_LINES))), rate(repeats)]
    return n, chars, symbols, dup, repeats, stats, len(lines)


def vector(n_words: int, n_lines: int, stats: list[float]) -> list[float]:
    """The statistics, and behind them the shares that one word and one line have in the text."""
    return [*stats, 1 / (n_words + PRIOR_WORDS), 1 / (n_lines + PRIOR_LINES)]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


# ---- minimum-covariance-determinant estimates, one per group, over all documents ----

#: Share of a group that the first estimate rests on.
CORE = 0.75
#: Concentration steps from each start.
STEPS = 5
#: Reweighting steps: all documents within this quantile of the estimate give the next one.
REWEIGHTS, WITHIN = 2, 0.975
#: Documents' worth of its language's estimate that a source's is given; the same from the corpus to a language.
SHRINK = 200.0
#: Distances are sorted into bins of this many to the factor 2.
_BINS_PER_OCTAVE = 16
#: Cells of a statistic's unit in which medians are found.
_CELLS = 1024


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-squared distribution by Wilson and Hilferty's cube root."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def chi2_share(x: float, k: int) -> float:
    """Share of the chi-squared distribution up to x, by the same cube root."""
    from statistics import NormalDist

    return NormalDist().cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5)


def consistency(share: float, p: int) -> float:
    """By how much the covariance of a Gaussian's innermost ``share`` is too small."""
    return 1.0 if share >= 1 else share / chi2_share(chi2_quantile(share, p), p + 2)


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of ``x`` under ``mean`` and ``prec`` as one JVM expression."""
    diff = [F.col("x")[i] - F.col("mean")[i] for i in range(p)]
    return sum((diff[i] * diff[j] * F.col("prec")[i * p + j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)), F.lit(0.0))


def _moments(p: int) -> list[Column]:
    """Sums of the vectors (with what stands behind the statistics) and of the statistics' products."""
    x = [F.col("x")[i] for i in range(p + 2)]
    return [F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s1"),
            F.array(*(F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p))).alias("s2")]


def _square(flat, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = flat
    return out + np.triu(out, 1).T


def _granted(cov: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """No statistic is told apart more finely than its sampling noise in the group's mean text, which also keeps the
    covariance from being singular where most of a group agrees exactly."""
    noise = np.array([c * shares[int(of == "lines")] for c, of in NOISE])
    return cov + np.diag(np.maximum(noise - np.diag(cov), 0))


def _estimate(n: int, s1, s2, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of a Gaussian whose innermost ``share`` has these sums."""
    p = len(STATISTICS)
    both = np.asarray(s1, dtype=np.float64) / n
    mean = both[:p]
    cov = _square(np.asarray(s2, dtype=np.float64) / n, p) - np.outer(mean, mean)
    cov[np.diag_indices(p)] = np.maximum(np.diag(cov), 0)
    return mean, _granted(consistency(share, p) * cov, both[p:])


def _model(key, start, mean: np.ndarray, cov: np.ndarray, n: int):
    return {"key": key, "start": start, "n": int(n), "mean": mean.tolist(), "cov": cov.ravel().tolist(), "prec": np.linalg.inv(cov).ravel().tolist(), "logdet": float(np.linalg.slogdet(cov)[1])}


_FIELDS = ["key", "start", "n", "mean", "cov", "prec", "logdet"]
_MODEL = "key string, start int, n long, mean array<double>, cov array<double>, prec array<double>, logdet double"


def _medians(rows: DataFrame, p: int) -> DataFrame:
    """(key, median array) of the statistics in (key, x), to one part in _CELLS of their unit: counts by cell are partial
    aggregates, and a group of any size ends as a few thousand of them for each statistic."""
    cells = rows.select("key", F.posexplode(F.transform(F.slice("x", 1, p), lambda v: F.floor(v * _CELLS).cast("int"))).alias("at", "cell")).groupBy("key", "at", "cell").agg(F.count("*").alias("n"))
    own = Window.partitionBy("key", "at")
    upto = F.sum("n").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    half = cells.withColumns({"upto": upto, "all": F.sum("n").over(own)}).where("2 * upto >= all and 2 * (upto - n) < all")
    return half.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("cell") / _CELLS).alias("v")))), lambda c: c["v"]).alias("median"))


def mcd_models(stats: DataFrame) -> DataFrame:
    """From (keys array<string>, x array<double>, as ``vector`` gives it): (key, n, mean, cov) of each key.

    Deterministic MCD: two starts for each group (medians with absolute deviations; medians with sign
    correlations), each followed by concentration steps over all its documents. A step sorts the group's
    distances into fine bins, of which the lowest that hold CORE of the group give the next mean and
    covariance: sums per bin are partial aggregates, so a group of any size costs a few hundred small rows.
    The start that ends with the least determinant is reweighted: the documents within its WITHIN quantile
    give the final estimate. Covariances are made consistent with Gaussian data, so that distances are
    chi-squared there.
    """
    p = len(STATISTICS)
    rows = stats.select(F.explode("keys").alias("key"), "x")
    shares = rows.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("x")[i]) for i in (p, p + 1))).alias("shares"))
    mid = cut(_medians(rows, p).join(shares, "key").select("key", "n", F.concat("median", "shares").alias("mid")), "mcd-medians")
    around = cut(rows.join(mid, "key").select("key", F.transform("x", lambda v, i: v - F.col("mid")[i]).alias("x")).groupBy("key").agg(
        F.array(*(F.avg(F.signum(F.col("x")[i]) * F.signum(F.col("x")[j])) for i in range(p) for j in range(i, p))).alias("signs")), "mcd-signs")
    apart = rows.join(mid.select("key", "mid"), "key").select("key", F.transform("x", lambda v, i: F.abs(v - F.col("mid")[i])).alias("x"))
    scale = mid.join(around, "key").join(_medians(apart, p).withColumnRenamed("median", "mad"), "key")

    def begin(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                mid, shares = np.array(r.mid)[:p], np.array(r.mid)[p:]
                dev = 1.4826 * np.array(r.mad)
                signs = _square(r.signs, p)
                spread = np.sqrt(np.maximum(np.diag(signs), 1e-9))
                corr = np.sin(np.pi / 2 * np.clip(signs / np.outer(spread, spread), -1, 1))
                w, v = np.linalg.eigh(corr)
                corr = v @ np.diag(np.maximum(w, 0.05)) @ v.T
                out += [_model(r.key, k, mid, _granted(c, shares), r.n) for k, c in enumerate((np.diag(dev**2), np.outer(dev, dev) * corr))]
            yield pd.DataFrame(out, columns=_FIELDS)

    models = cut(scale.mapInPandas(begin, _MODEL), "mcd-models")

    def concentrate(key, pdf):
        pdf = pdf.sort_values("bin")
        total, n = pdf.n.sum(), np.cumsum(pdf.n.to_numpy())
        core = slice(0, int(np.searchsorted(n, CORE * total)) + 1)
        held = n[core][-1]
        mean, cov = _estimate(held, np.sum(pdf.s1.to_list()[core], axis=0), np.sum(pdf.s2.to_list()[core], axis=0), held / total)
        return pd.DataFrame([_model(key[0], int(key[1]), mean, cov, total)], columns=_FIELDS)

    for _ in range(STEPS):
        near = rows.join(models.select("key", "start", "mean", "prec"), "key").select("key", "start", "x", _distance(p).alias("d2"))
        bins = near.groupBy("key", "start", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * _BINS_PER_OCTAVE).alias("bin")).agg(*_moments(p))
        models = cut(bins.groupBy("key", "start").applyInPandas(concentrate, _MODEL), "mcd-models")
    models = models.groupBy("key").agg(F.min_by(F.struct(*_FIELDS[1:]), F.struct("logdet", "start")).alias("m")).select("key", "m.*")

    def reweight(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                mean, cov = np.array(r.mean), np.array(r.cov).reshape(p, p)
                if r.within > 0:  # else the group's own is kept
                    mean, cov = _estimate(r.within, r.s1, r.s2, WITHIN)
                out.append(_model(r.key, int(r.start), mean, cov, r.n))
            yield pd.DataFrame(out, columns=_FIELDS)

    for _ in range(REWEIGHTS):
        near = rows.join(models.select("key", "mean", "prec"), "key").where(_distance(p) <= chi2_quantile(WITHIN, p))
        sums = near.groupBy("key").agg(*_moments(p)).withColumnRenamed("n", "within")
        both = models.join(sums, "key", "left").withColumn("within", F.coalesce("within", F.lit(0)))
        models = cut(both.mapInPandas(reweight, _MODEL), "mcd-models")
    return models.select("key", "n", "mean", "cov")


def statistics(docs: DataFrame, within: str | None = None) -> DataFrame:
    """``docs`` with the base counts and the ``vector`` x of its column text, which is left out; or, unchanged, with those of
    the field text of its struct ``within``."""
    bounded_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if within or f.name != "text"]
    extra = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    extra += [T.StructField("base_failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))]

    def run(batches):
        for b in batches:
            c = [counts(t) for t in utf8(b.column(b.schema.names.index(within)).field("text") if within else b.column(b.schema.names.index("text")))]
            cols = [pa.array([r[k] for r in c], pa.int64()) for k in range(5)]
            failed = pa.array([base_failed(r[0], r[4]) for r in c], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.names.index(f.name)) for f in own), *cols, failed, pa.array([vector(r[0], r[6], r[5]) for r in c], pa.list_(pa.float64()))],
                names=[f.name for f in own] + [f.name for f in extra])

    return docs.mapInArrow(run, T.StructType([*own, *extra]))


def _part(column: str) -> Column:
    """A group name that tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def shrunk(n: float, mean: np.ndarray, cov: np.ndarray, whole: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A group's estimate mixed with that of the whole that it belongs to, as SHRINK documents of the whole."""
    w, apart = n / (n + SHRINK), mean - whole[0]
    return w * mean + (1 - w) * whole[0], w * cov + (1 - w) * whole[1] + w * (1 - w) * np.outer(apart, apart)


def group_models(stats: DataFrame) -> DataFrame:
    """(lang, source, mean, prec) for every group of (lang, source, base_failed, x): null where no document passes the base rule."""
    p = len(STATISTICS)
    keyed = stats.withColumn("keys", F.array(F.lit("all"), F.concat(F.lit("l"), "lang"), F.concat(F.lit("s"), "lang", F.lit("\x1f"), "source")))
    models = mcd_models(keyed.where("not base_failed").select("keys", "x"))
    out = keyed.groupBy("lang", "source").agg(F.first("keys").alias("keys"))
    for k in range(3):
        out = out.join(models.select(F.col("key").alias(f"k{k}"), F.struct("n", "mean", "cov").alias(f"m{k}")), F.col("keys")[k] == F.col(f"k{k}"), "left").drop(f"k{k}")

    def finish(batches):
        for pdf in batches:
            means, precs = [], []
            for own in zip(pdf.m0, pdf.m1, pdf.m2):
                now = None
                for m in own:  # the corpus, the language, the source
                    if m is not None:
                        mean, cov = np.array(m["mean"]), np.array(m["cov"]).reshape(p, p)
                        now = (mean, cov) if now is None else shrunk(m["n"], mean, cov, now)
                means.append(None if now is None else now[0].tolist())
                precs.append(None if now is None else np.linalg.inv(now[1]).ravel().tolist())
            yield pd.DataFrame({"lang": pdf.lang, "source": pdf.source, "mean": means, "prec": precs})

    return cut(out.mapInPandas(finish, "lang string, source string, mean array<double>, prec array<double>"), "quality-models")


def _verdict() -> Column:
    return ~F.col("base_failed") & (F.col("distance2") <= chi2_quantile(0.99, len(STATISTICS)))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    ``docs``: doc_id, text, lang, source. A null text has no words and fails the base rule; null languages and
    sources are groups of their own. distance2 is the squared Mahalanobis distance from the robust estimate of the
    document's language and source, which is drawn towards its language's and that towards the corpus's, the more so
    the fewer documents there are; beyond the 99 % quantile for as many statistics the document is an outlier.
    Documents that fail the base rule take no part in the estimates. Each row of ``docs`` gives one row, repeated ids
    included; an empty table gives an empty result; other columns are not looked at.
    """
    held = cut(statistics(docs.select("doc_id", _part("lang").alias("lang"), _part("source").alias("source"), "text")), "quality")
    out = held.join(group_models(held), ["lang", "source"], "left").withColumn("distance2", F.coalesce(_distance(len(STATISTICS)), F.lit(0.0)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _verdict().alias("kept"), "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Nulls, empty texts, repeated rows and empty tables are treated as there. Counts are made again where the rows are,
    which is cheaper than to move the texts to their verdicts."""
    held = cut(statistics(docs.select(_part("lang").alias("lang"), _part("source").alias("source"), "text")), "quality")
    models = group_models(held).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "mean", "prec")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), _part("lang").alias("__lang"), _part("source").alias("__source"))
    out = statistics(whole, "__row").join(models, ["__lang", "__source"], "left").withColumn("distance2", F.coalesce(_distance(len(STATISTICS)), F.lit(0.0)))
    return out.where(_verdict()).select("__row.*")
