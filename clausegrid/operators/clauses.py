"""Operators that need match offsets in a text, which column expressions do not give: sub-headings inside wrapper
sections, durations near an anchor, and the structural address of an outline. Each works on one row, or one document's
few outline rows, at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PREFIX, UNIT
from ..functions.primitives import BINDINGS
from .project import TopicMap, enrich

# ---- fixed values ----
WRAPPERS = ("miscellaneous",)
SUBHEADING = re.compile(r"(?m)^[ \t]*([A-Z][A-Za-z][A-Za-z0-9\s,.&'\-/]{1,58}?)\.\s+(?=[A-Z])")
SENTENCE_OPENERS = ("This ", "If ", "The ", "By ", "In ", "For ")
WRAPPER_CHARS, LABEL_WORDS = 200, 7
DURATION = re.compile(r"(?i)\b(\d+(?:[.,]\d+)?)\s*(hours|hour|hrs|hr|h|minutes|minute|mins|min|seconds|second|secs|sec|days|day|weeks|week|wk)(?:\b|(?=[A-Z]))")
UNIT_SECONDS = {"h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
                "sec": 1, "secs": 1, "second": 1, "seconds": 1, "day": 86400, "days": 86400, "wk": 604800, "week": 604800, "weeks": 604800}


def letters(k: int) -> str:
    """a to z, then aa, ab and so on."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = ascii_lowercase[r] + out
    return out


def split_wrapper(text: str | None) -> list[tuple[str, int, str]]:
    """(label, start of the body, body) of the labelled parts of a wrapper text; none unless there are two or more."""
    if not text or len(text) < WRAPPER_CHARS:
        return []
    fair = [m for m in SUBHEADING.finditer(text) if 1 <= len(m[1].split()) <= LABEL_WORDS and not m[1].strip().startswith(SENTENCE_OPENERS)]
    if len(fair) < 2:
        return []
    ends = [m.start() for m in fair[1:]] + [len(text)]
    parts = [(m[1].strip(), m.end(), text[m.end():e].strip()) for m, e in zip(fair, ends)]
    return [p for p in parts if p[2]]


def expand_wrappers(sections: DataFrame, topics: TopicMap, features: bool = True) -> DataFrame:
    """Adds the parts of wrapper sections as sections of their own, classified by their labels; parents stay.

    A part is ``{parent}_a``, ``_b`` and so on, has its ``parent_section`` and stands behind its parent. It inherits
    the parent's mark as a supplement and is never the operative section by itself.
    """
    base = ("doc_id", "ord", "section_id", "heading", "heading_path", "text", "char_start")
    held = sections if "heading_path" in sections.columns else sections.withColumn("heading_path", F.lit("/"))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    form = ", ".join(f"{c} {kinds[c]}" for c in base) + ", parent_section string, supplement boolean"

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [(r.doc_id, r.ord, f"{r.section_id}_{letters(k)}", label, f"{r.heading_path}/{label}", body, r.char_start + at, r.section_id, r.is_country_supplement)
                    for r in pdf.itertuples() for k, (label, at, body) in enumerate(split_wrapper(r.text))]
            yield pd.DataFrame(rows, columns=[*base, "parent_section", "supplement"])

    wrappers = held.where(F.col("primary_topic").isin(*WRAPPERS)).select(*base, "is_country_supplement")
    parts = enrich(wrappers.mapInPandas(run, form), topics, features, inherit=False)
    parts = parts.withColumn("is_country_supplement", F.col("supplement")).withColumn("is_operative_for_topic", F.lit(False)).drop("supplement")
    return held.withColumn("parent_section", F.lit(None).cast("string")).unionByName(parts, allowMissingColumns=True)


def _sentence(text: str, begin: int, end: int) -> tuple[int, int]:
    """The sentence around a span: up to a line end, or to a stop that white space follows."""
    stop = lambda i: text[i] in "\r\n" or (text[i] in ".!?" and (i + 1 == len(text) or text[i + 1].isspace()))
    low = next((i + 1 for i in range(begin - 1, -1, -1) if stop(i)), 0)
    high = next((i + 1 for i in range(end, len(text)) if stop(i)), len(text))
    return low, high


def duration_near(text: str | None, anchor: str, width: int = 120, bindings: list[tuple[int, int, float]] | None = None) -> float | None:
    """Seconds of the duration nearest to an anchor in its sentence, within ``width`` characters; null without one.

    The anchor's places are its bindings (start, length, similarity), else where its words stand. Nearest first, then by
    similarity, the anchor's place, the duration's place and its text.
    """
    if not text or not anchor:
        return None
    spans = bindings or [(m.start(), m.end() - m.start(), 1.0) for m in re.finditer(rf"(?i)\b{re.escape(anchor)}\b", text)]
    found = []
    for start, size, cos in spans:
        end = start + size
        if start < 0 or end > len(text):
            continue
        low, high = _sentence(text, start, end)
        low, high = max(low, start - max(0, width)), min(high, end + max(0, width))
        for m in DURATION.finditer(text[low:high]):
            a, b = low + m.start(), low + m.end()
            gap = a - end if a >= end else start - b if b <= start else 0
            found.append((gap, -cos, start, a, m[0], float(m[1].replace(",", ".")) * UNIT_SECONDS[m[2].lower()]))
    return min(found)[-1] if found else None


def seconds_near(text: Column, anchor: str, width: int = 120, bindings: Column | None = None) -> Column:
    """``duration_near`` as a column; bindings: as ``semantic.bind`` gives them, null or empty to look for the anchor's name."""
    @F.pandas_udf("double")
    def near(texts: pd.Series, starts: pd.Series, sizes: pd.Series, cosines: pd.Series) -> pd.Series:
        bound = [None if s is None else list(zip(map(int, s), map(int, n), map(float, c))) for s, n, c in zip(starts, sizes, cosines)]
        return pd.Series([duration_near(t, anchor, width, b) for t, b in zip(texts, bound)], dtype="float64")

    of = F.lit(None).cast(BINDINGS) if bindings is None else bindings
    each = lambda name: F.transform(of, lambda x: x[name])
    found = near(text, *map(each, ("char_start", "char_length", "similarity")))
    return F.when(~F.isnan(found), found)


def tree_fingerprints(tree: DataFrame, source: str = "doc_id", builder: str = "outline", version: str = "1") -> DataFrame:
    """(doc_id, fingerprint) of outlines (doc_id, node_id, parent_id, title, level, start, end): by shape, places and titles."""
    def sign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in sorted(pdf.itertuples(), key=lambda r: r.start):
            below.setdefault(r.parent_id if isinstance(r.parent_id, str) else None, []).append(r)
        text: dict = {}
        todo = [(r, False) for r in below.get(None, [])]
        while todo:  # children before parents, without recursion
            r, ready = todo.pop()
            kids = below.get(r.node_id, [])
            if not ready:
                todo += [(r, True), *((k, False) for k in kids)]
                continue
            text[r.node_id] = f"{r.node_id}|L{r.level}|{r.start}..{r.end}|T={r.title}|" + "".join(f"({text[k.node_id]})" for k in kids)
        whole = "".join(f"({text[r.node_id]})" for r in below.get(None, []))
        parts = (str(key[0]), builder, version, whole)
        return pd.DataFrame({"doc_id": [key[0]], "fingerprint": [PREFIX + hashlib.sha256("".join(p + UNIT for p in parts).encode()).hexdigest()]})

    return tree.groupBy(source).applyInPandas(sign, f"doc_id {tree.schema[source].dataType.simpleString()}, fingerprint string")
