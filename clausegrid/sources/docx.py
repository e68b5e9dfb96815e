"""Reviewed Word files: comments, and replacements as tracked changes, one document at a time."""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f"{{{_NS}}}"
#: Every change carries this time, so that equal reviews are equal files.
STAMP = "2000-01-01T00:00:00Z"
ET.register_namespace("w", _NS)


def _el(tag: str, text: str | None = None, **attrs) -> ET.Element:
    e = ET.Element(_W + tag, {_W + k: str(v) for k, v in attrs.items()})
    if text is not None:
        e.text = text
        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return e


def _run(text: str, tag: str = "t") -> ET.Element:
    r = _el("r")
    r.append(_el(tag, text))
    return r


def _split(paragraph: ET.Element, run: ET.Element, at: int) -> None:
    """Parts a run behind its first ``at`` characters: two runs with the same properties."""
    second = copy.deepcopy(run)
    left = at
    for own, other in zip(run.findall(f"{_W}t"), second.findall(f"{_W}t")):
        text = own.text or ""
        own.text, other.text = text[:max(0, left)], text[max(0, left):]
        for t in (own, other):
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        left -= len(text)
    paragraph.insert(list(paragraph).index(run) + 1, second)


def _squeezed(raw: str) -> list[int]:
    """For each character of the text with white space made single and trimmed, its place in ``raw``; and its end."""
    places: list[int] = []
    for k, c in enumerate(raw):
        if not c.isspace():
            if places and k and raw[k - 1].isspace():
                places.append(k - 1)
            places.append(k)
    return [*places, places[-1] + 1 if places else 0]


def _replace(paragraph: ET.Element, start: int, stop: int, text: str, who: dict) -> None:
    """Marks the characters start to stop of the squeezed text as deleted and ``text`` behind them as inserted."""
    size = lambda r: sum(len(t.text or "") for t in r.findall(f"{_W}t"))
    places = _squeezed("".join(t.text or "" for t in paragraph.iter(f"{_W}t")))
    start, stop = min(start, len(places) - 1), min(stop, len(places) - 1)
    low, high = places[start], places[stop - 1] + 1 if stop > start else places[start]
    for edge in (low, high):
        at = 0
        for r in paragraph.findall(f"{_W}r"):
            if at < edge < at + size(r):
                _split(paragraph, r, edge - at)
                break
            at += size(r)
    gone, new, at, last = _el("del", **who), _el("ins", **{**who, "id": 100_000 + who["id"]}), 0, None
    for r in paragraph.findall(f"{_W}r"):
        n = size(r)
        if n and low <= at and at + n <= high:
            if last is None:
                paragraph.insert(list(paragraph).index(r), gone)
                last = gone
            paragraph.remove(r)
            for t in r.iter(f"{_W}t"):
                t.tag = _W + "delText"
            gone.append(r)
        at += n
    new.append(_run(text))
    if last is None:  # nothing to delete, such as text inside a link: the new text stands at the end
        paragraph.append(new)
    else:
        paragraph.insert(list(paragraph).index(gone) + 1, new)


def annotate_docx(content: bytes, notes: list[dict], author: str = "Review") -> bytes:
    """Writes notes (comment_id, kind, start, length, text; offsets in the body's squeezed paragraphs joined by line feeds)
    into a Word file. A comment is anchored to its paragraph; a replacement marks what its span covers as deleted, runs being
    split at the span's ends, and puts the new text behind that as inserted. A note whose place is not found is left out."""
    src = zipfile.ZipFile(io.BytesIO(content))
    parts = {n: src.read(n) for n in src.namelist()}
    doc = ET.fromstring(parts["word/document.xml"])
    spans, at = [], 0
    for p in doc.find(f"{_W}body").findall(f"{_W}p"):
        text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")).split())
        if text:
            spans.append((at, at + len(text), p))
            at += len(text) + 1
    comments = ET.Element(_W + "comments")
    for n in sorted(notes, key=lambda n: n["comment_id"]):
        own = next((p for a, b, p in spans if a < n["start"] + max(1, n["length"]) and n["start"] < b), None)
        if own is None:
            continue
        who = {"id": n["comment_id"], "author": author, "date": STAMP}
        if n["kind"] == "replace":
            begin = next(a for a, _, p in spans if p is own)
            _replace(own, max(0, n["start"] - begin), n["start"] + n["length"] - begin, n["text"], who)
            continue
        c = _el("comment", **who, initials="".join(w[0] for w in author.split())[:3])
        p = _el("p")
        p.append(_run(n["text"]))
        c.append(p)
        comments.append(c)
        first = 1 if len(own) and own[0].tag == _W + "pPr" else 0
        own.insert(first, _el("commentRangeStart", id=n["comment_id"]))
        own.append(_el("commentRangeEnd", id=n["comment_id"]))
        mark = _el("r")
        mark.append(_el("commentReference", id=n["comment_id"]))
        own.append(mark)
    parts["word/document.xml"] = ET.tostring(doc, encoding="utf-8", xml_declaration=True)
    if len(comments):
        parts["word/comments.xml"] = ET.tostring(comments, encoding="utf-8", xml_declaration=True)
        kinds = parts["[Content_Types].xml"].decode()
        if "comments+xml" not in kinds:
            parts["[Content_Types].xml"] = kinds.replace("</Types>", '<Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>').encode()
        rels = parts.get("word/_rels/document.xml.rels", b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>').decode()
        if "relationships/comments" not in rels:
            parts["word/_rels/document.xml.rels"] = rels.replace("</Relationships>", '<Relationship Id="rIdReview" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments" Target="comments.xml"/></Relationships>').encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in sorted(parts):
            z.writestr(zipfile.ZipInfo(n, (2000, 1, 1, 0, 0, 0)), parts[n])
    return out.getvalue()


def reviewed_docx(files: DataFrame, notes: DataFrame, author: str = "Review") -> DataFrame:
    """(doc_id, content) of the reviewed files; notes: doc_id, comment_id, kind, start, length, text."""
    held = notes.groupBy("doc_id").agg(F.collect_list(F.struct("comment_id", "kind", "start", "length", "text")).alias("notes"))
    joined = files.where("kind = 'docx'").select("doc_id", "content").join(held, "doc_id")

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "content": [annotate_docx(bytes(c), [dict(n) if isinstance(n, dict) else n.asDict() for n in ns], author) for c, ns in zip(pdf.content, pdf.notes)]})

    return joined.mapInPandas(run, "doc_id string, content binary")
