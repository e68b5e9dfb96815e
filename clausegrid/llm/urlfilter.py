"""URL filtering by per-host trees of path templates.

1. Each path becomes a shape: identifiers and digit runs are generalised where they stand,
   and pages are summed per (host, shape), so what follows sees shapes and not pages.
2. The tree grows level by level, for as long as a node has labels enough to tell any two
   branches apart. Below a node, a segment is a branch of its own if the purity of its
   subtree, or of any place below it, differs from that of the same place below its siblings
   (Hoeffding's bound as in ALERGIA's state merging, its chance of error shared by all tests of
   the node). All other segments are one wildcard.
3. Branches that stand out in the same places and in the same directions are merged in order
   of purity where their purities cannot be told apart.
4. A template is a path from the root. Its purity, the share of good labels smoothed
   towards the corpus's, decides: its pages are blocked if it is below a threshold, which is
   the one that does best on labels that the tree has not seen.

Explicit rules come first; the tree judges what no rule fits.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_mod

#: Chance of telling apart branches of a node that are all alike.
ALPHA = 0.05
#: With fewer labels below a node no two branches can be told apart (eight times Hoeffding's squared bound for two tests).
LEAST_LABELS = 4 * math.log(4 / ALPHA)
#: Labels' worth of the corpus's purity that each template is given.
PRIOR = 20.0
#: A page's label is kept from the tree and chooses the threshold if the id's crc32 leaves no rest by this.
HELD_OUT = 5
#: The threshold where labels do not choose: the nearest to it of the best ones is taken.
THRESHOLD = 0.5
#: Purities are told apart to one part in this where branches are merged and the threshold is chosen.
BINS = 100

#: (verdict, rule): host, then a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape_of(path: Column) -> Column:
    """The path with UUIDs and long hexadecimal names as %, digit runs as #."""
    ids = F.regexp_replace(path, r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}", "%")
    return F.regexp_replace(ids, r"[0-9]+", "#")


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the path; else nulls."""
    rule = verdict = None
    for say, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def bound(tests: Column | float) -> Column:
    """Hoeffding's factor for the chance ALPHA of an error in any of so many tests."""
    return F.sqrt(0.5 * F.log(2.0 * tests / ALPHA))


def alike(n1: float, g1: float, n2: float, g2: float, alpha: float = ALPHA) -> bool:
    """Hoeffding's test: g1 good of n1 labels and g2 of n2 may have one purity."""
    if not n1 or not n2:
        return True
    return abs(g1 / n1 - g2 / n2) <= math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)


def merge_bins(labelled: list[float], good: list[float]) -> list[int]:
    """For bins in order of purity, the first bin of each one's merged run: neighbours join while they are alike."""
    first: list[int] = []
    n = g = 0.0
    for k, (a, b) in enumerate(zip(labelled, good)):
        if k and alike(n, g, a, b):
            first.append(first[-1])
            n, g = n + a, g + b
        else:
            first.append(k)
            n, g = a, b
    return first


_NODE = ["host", "template"]


def _branches(at: DataFrame) -> DataFrame:
    """(host, template, seg, name) of the segments that are branches of their own, from labelled rows (…, segs, seg, level,
    labelled, good). Merging sees at most BINS + 1 rows of a node and profile, whatever the number of segments."""
    rest = F.transform(F.sequence(F.lit(0), F.size("segs") - F.col("level") - 1), lambda j: F.xxhash64(F.array_join(F.slice("segs", F.col("level") + 2, j), "/"), j))
    places = (at.select(*_NODE, "seg", F.explode(rest).alias("place"), "labelled", "good").groupBy(*_NODE, "seg", "place")
              .agg(F.sum("labelled").alias("n"), F.sum("good").alias("g")))
    whole = places.groupBy(*_NODE, "place").agg(F.sum("n").alias("all_n"), F.sum("g").alias("all_g"))
    tests = places.groupBy(*_NODE).agg(F.count("*").alias("tests"))
    others, good = F.col("all_n") - F.col("n"), F.col("all_g") - F.col("g")
    gap = F.col("g") / F.col("n") - good / others
    told = (places.join(whole, [*_NODE, "place"]).join(tests, _NODE).where(others > 0)
            .where(F.abs(gap) > bound(F.col("tests")) * (1 / F.sqrt("n") + 1 / F.sqrt(others))))
    profile = told.groupBy(*_NODE, "seg").agg(F.hash(F.sort_array(F.collect_set(F.struct("place", F.signum(gap).alias("sign"))))).alias("profile"))
    own = at.groupBy(*_NODE, "seg").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g")).join(profile, [*_NODE, "seg"])
    own = own.withColumn("bin", F.floor(F.col("g") / F.col("n") * BINS).cast("int"))
    bins = own.groupBy(*_NODE, "profile", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf[[*_NODE, "profile", "bin"]].assign(run=merge_bins(pdf.n.tolist(), pdf.g.tolist()))

    runs = bins.groupBy(*_NODE, "profile").applyInPandas(merge, "host string, template string, profile int, bin int, run int")
    placed = own.select(*_NODE, "seg", "profile", "bin").join(runs, [*_NODE, "profile", "bin"])
    names = placed.groupBy(*_NODE, "profile", "run").agg(F.min("seg").alias("least"), F.count("*").alias("size"))
    name = F.when(F.col("size") == 1, F.col("least")).otherwise(F.concat("least", F.lit("+"), (F.col("size") - 1).cast("string")))
    return placed.join(names, [*_NODE, "profile", "run"]).select(*_NODE, "seg", name.alias("name"))


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) from (host, shape, labelled, good): one row for each (host, shape). An empty table gives an
    empty one. Levels end where no node has labels enough to split; what is left of a path there is a wildcard a segment."""
    rows = cut(shapes.select("host", "shape", "labelled", "good", F.split("shape", "/").alias("segs"), F.lit("").alias("template")), "templates")
    done, level = [], 0
    while True:
        left = F.size("segs") - level
        node = rows.groupBy(*_NODE).agg(F.sum("labelled").alias("labels"), F.count_distinct(F.get("segs", F.lit(level))).alias("fan"), F.max(left).alias("deepest"))
        known = rows.join(node, _NODE)
        ends = (F.col("labels") < LEAST_LABELS) | (F.col("deepest") <= 0)
        done.append(known.where(ends).select("host", "shape", F.concat("template", F.repeat(F.lit("/*"), F.greatest(left, F.lit(0)))).alias("template")))
        at = known.where(~ends).withColumn("seg", F.get("segs", F.lit(level))).withColumn("level", F.lit(level))
        named = _branches(at.where("seg is not null and labelled > 0"))
        joined = at.join(named, [*_NODE, "seg"], "left")
        step = F.coalesce("name", F.when(F.col("fan") == 1, F.col("seg")).otherwise("*"))
        grown = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))
        rows = cut(joined.select("host", "shape", "labelled", "good", "segs", grown.alias("template")), "templates")
        level += 1
        if rows.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def choose_threshold(held: list[tuple[float, float, float]], default: float = THRESHOLD) -> float:
    """From (purity, held-out labels, good ones) of templates or bins of them: the threshold below which bad labels
    outnumber good ones the most; of equally good ones the nearest to ``default``."""
    best = (0.0, 0.0, default)
    for t in sorted({default, *(k / BINS for k in range(BINS + 1))}):
        gain = sum(n - 2 * g for p, n, g in held if p < t)
        best = min(best, (-gain, abs(t - default), t))
    return best[2]


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float | None = None, prior: float = PRIOR) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity.

    A page's label is that of the same id in ``labels`` (several: the worst); good is quality 1 and toxic 0, a
    missing mark counting as good. Pages without a url have an empty host and path and share one template. A page id
    that repeats gives a row each; a null page id is an unlabelled page. Without any label all templates are allowed;
    an empty table of pages gives an empty result. ``threshold``: None to choose it from held-out labels; purities
    count all labels in the end. Other columns of both tables are not looked at.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("shape", shape_of(F.col("path")))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        ((F.coalesce(F.min("quality"), F.lit(1)) == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("double").alias("mark"))
    held = id_mod("page_id", HELD_OUT) == 0
    some = lambda keep: [F.count(F.when(keep, F.col("mark"))).cast("double"), F.coalesce(F.sum(F.when(keep, F.col("mark"))), F.lit(0.0))]
    shapes = cut(named.join(marks, "page_id", "left").groupBy("host", "shape").agg(
        *(c.alias(n) for c, n in zip([*some(~held), *some(held)], ("labelled", "good", "held", "held_good")))), "shapes")
    tree = cut(template_tree(shapes).join(shapes, ["host", "shape"]), "templates")
    total = tree.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("labelled", "good", "held", "held_good"))).first()
    smooth = lambda g, n, share: (g + prior * share) / (n + prior)
    sums = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("labelled", "good", "held", "held_good")))
    if threshold is None:
        seen = F.floor(smooth(F.col("good"), F.col("labelled"), total[1] / total[0] if total[0] else 1.0) * BINS) / BINS
        threshold = choose_threshold([tuple(r) for r in sums.groupBy(seen.alias("purity")).agg(F.sum("held"), F.sum("held_good")).collect()])  # BINS + 1 rows
    n = total[0] + total[2]
    purity = sums.select("host", "template", smooth(F.col("good") + F.col("held_good"), F.col("labelled") + F.col("held"), (total[1] + total[3]) / n if n else 1.0).alias("purity"))
    verdicts = tree.select("host", "shape", "template").join(purity, ["host", "template"]).select("host", "shape", "template", "purity")
    rule, say = match_rules(F.col("host"), F.col("path"), rules)
    return named.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(say, F.when(F.col("purity") < threshold, "block").otherwise("allow")).alias("verdict"), "template", "purity")
