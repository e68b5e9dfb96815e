"""Files to documents and blocks.

``read_files`` identifies sources by content; the splitters turn one document's text or
bytes into blocks inside ``mapInPandas``: a document is parsed where it lies, and nothing
but blocks moves on. Block columns: doc_id, block_ord, block_id, kind (heading, paragraph,
list_item, code, table_cell), text, char_start, char_length, heading_level, heading_path.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PREFIX, content_hash, normalise_source

BLOCKS = "doc_id string, block_ord int, block_id string, kind string, text string, char_start int, char_length int, heading_level int, heading_path string"
KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}
TEXT_KINDS = ("markdown", "text", "html")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, path, file_name, kind, byte_length, content, text, problem): text kinds are addressed without byte order mark and
    with line feeds alone, others by their bytes. Kinds without a parser have a problem instead of failing the job."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))
    text = F.when(kind.isin(*TEXT_KINDS), normalise_source(F.decode("content", "UTF-8")))
    return files.select(
        F.when(text.isNotNull(), content_hash(text)).otherwise(F.concat(F.lit(PREFIX), F.sha2("content", 256))).alias("doc_id"),
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), kind.alias("kind"), F.col("length").alias("byte_length"), "content", text.alias("text"),
        F.when(~kind.isin("markdown", "text", "docx"), F.concat(F.lit("no parser for "), kind)).alias("problem"))


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Outline:
    """Stack of headings above a block."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = []

    def push(self, level: int, title: str) -> str:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))
        return self.path()

    def path(self) -> str:
        return "/" + "/".join(t for _, t in self.stack)


_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_ITEM = re.compile(r"^( *)(?:[-+*]|\d{1,9}[.)])(?: +|$)(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_INLINE = ((re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"), (re.compile(r"`([^`]+)`"), r"\1"),
           (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S), r"\2"), (re.compile(r"(?<![\w*])\*(?=\S)([^*]+?)(?<=\S)\*"), r"\1"), (re.compile(r"(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)"), r"\1"),
           (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"))


def inline_text(text: str) -> str:
    """Literal text of Markdown inlines; soft line breaks are dropped without a space."""
    text = text.replace("\n", "")
    for rx, by in _INLINE:
        text = rx.sub(by, text)
    return squeeze(text)


def markdown_blocks(text: str) -> Iterator[tuple[str, str, int, int, int | None, str]]:
    """(kind, text, start, length, level, heading path) of a Markdown text, in order; quotes and lists are gone into."""
    outline, lines, at = Outline(), [], 0
    for raw in text.split("\n"):
        lines.append((at, raw))
        at += len(raw) + 1
    k = 0
    para: list[tuple[int, str]] = []
    kind = "paragraph"

    def close():
        nonlocal para, kind
        out = []
        if para:
            body = inline_text("\n".join(x.strip() for _, x in para))
            if body:
                begin, last = para[0][0], para[-1]
                out = [(kind, body, begin, last[0] + len(last[1]) - begin, None, outline.path())]
        para, kind = [], "paragraph"
        return out

    while k < len(lines):
        start, raw = lines[k]
        quote = re.match(r"^ {0,3}(?:> ?)+", raw)
        line, shift = (raw[quote.end():], quote.end()) if quote else (raw, 0)
        fence = _FENCE.match(line)
        if fence:
            yield from close()
            code, k = [], k + 1
            while k < len(lines) and not lines[k][1].strip().startswith(fence[1]):
                code.append(lines[k][1])
                k += 1
            body = squeeze("\n".join(code))
            if body:
                yield "code", body, start, (lines[min(k, len(lines) - 1)][0] - start), None, outline.path()
            k += 1
            continue
        heading = _HEADING.match(line)
        if heading:
            yield from close()
            title = inline_text(heading[2] or "")
            if title:
                yield "heading", title, start + shift, len(line), len(heading[1]), outline.push(len(heading[1]), title)
        elif para and kind == "paragraph" and _SETEXT.match(line):
            body = inline_text("\n".join(x.strip() for _, x in para))
            level = 1 if "=" in line else 2
            yield "heading", body, para[0][0], start + len(raw) - para[0][0], level, outline.push(level, body)
            para = []
        elif not line.strip():
            yield from close()
        elif _RULE.match(line):
            yield from close()
        elif (item := _ITEM.match(line)) and (item[2] or not para):
            yield from close()
            kind = "list_item"
            if item[2]:
                para = [(start + shift + line.index(item[2], len(item[1])), item[2])]
        else:
            lead = len(line) - len(line.lstrip())
            para.append((start + shift + (lead if not para else 0), line[lead:] if not para else line))
        k += 1
    yield from close()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> Iterator[tuple[str, str, int, int, int | None, str]]:
    """The same of a Word file's body: Heading1 to 9 and ListParagraph styles, a block for each table cell with text."""
    outline, at = Outline(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda el: "".join(t.text or "" for t in el.iter(f"{_W}t"))
    for el in body if body is not None else ():
        if el.tag == f"{_W}p":
            text = squeeze(said(el))
            if not text:
                continue
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.fullmatch(r"Heading([1-9])", name)
            if level:
                path = outline.push(int(level[1]), text)
                yield "heading", text, at, len(text), int(level[1]), path
            else:
                yield "list_item" if name == "ListParagraph" else "paragraph", text, at, len(text), None, outline.path()
            at += len(text) + 1
        elif el.tag == f"{_W}tbl":
            for r, row in enumerate(el.iter(f"{_W}tr")):
                for c, cell in enumerate(row.iter(f"{_W}tc")):
                    text = squeeze(said(cell))
                    if text:
                        yield "table_cell", text, at, len(text), None, f"{outline.path().rstrip('/')}/table/r{r}/c{c}"
                        at += len(text) + 1


_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)[.)]?\s+\S")


def page_blocks(text: str, font: float | None = None, median: float | None = None) -> Iterator[tuple[str, str, int, int, int | None, str]]:
    """The same of a page's extracted text: parts between blank lines; short capitals, numbered or large parts are headings."""
    outline = Outline()
    for m in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", text):
        part = squeeze(m[0])
        if not part:
            continue
        number = _NUMBERED.match(part)
        large = font is not None and median and font >= 1.2 * median and len(part) <= 200
        if (len(part) <= 120 and any(c.isalpha() for c in part) and part == part.upper()) or (number and len(part) <= 200) or large:
            level = number[1].count(".") + 1 if number else 1
            yield "heading", part, m.start(), len(m[0]), level, outline.push(level, part)
        else:
            yield "paragraph", part, m.start(), len(m[0]), None, outline.path()


def blocks(files: DataFrame) -> DataFrame:
    """The blocks of files (doc_id, kind, content, text); files without a parser, or broken ones, give none."""
    def run(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                try:
                    found = list(markdown_blocks(f.text or "") if f.kind == "markdown" else docx_blocks(bytes(f.content)) if f.kind == "docx" else page_blocks(f.text or "") if f.kind == "text" else ())
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                rows += [(f.doc_id, k, f"b_{k:08d}", *b) for k, b in enumerate(found)]
            out = pd.DataFrame(rows, columns=["doc_id", "block_ord", "block_id", "kind", "text", "char_start", "char_length", "heading_level", "heading_path"])
            yield out.astype({"heading_level": "Int32"})

    return files.select("doc_id", F.col("kind"), "content", "text").mapInPandas(run, BLOCKS)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of web pages by pattern, inside the JVM: doc_id, block_ord, kind, text."""
    rx = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>([^<]*)"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html_col), F.lit(rx), F.lit(1)), F.regexp_extract_all(F.col(html_col), F.lit(rx), F.lit(2)))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(pairs).alias("block_ord", "b"))
    tag = F.lower("b.0")
    return rows.select("doc_id", "block_ord", F.when(F.startswith(tag, F.lit("h")), "heading").when(tag == "li", "list_item").otherwise("paragraph").alias("kind"), F.trim("b.1").alias("text"),
                       F.when(F.startswith(tag, F.lit("h")), F.substring(tag, 2, 1).cast("int")).alias("heading_level"))
