"""Text tests that rules may call, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
BOILERPLATE = (
    "to be completed", "to be defined", "to be determined", "to be confirmed", "will be completed", "will be defined", "will be determined",
    "will be added", "tbd", "tba", "[insert", "<insert", "(insert)", "insert text here", "fill in", "fill-in", "lorem ipsum", "<placeholder>",
    "[placeholder]", "{placeholder}", "placeholder text", "n/a — to be added", "n/a - to be added", "coming soon", "[to do]", "todo:", "to-do:",
    "stub section", "click here to add", "this section will describe", "this section describes", "this section will be completed", "details to follow",
)
REVIEW_TAG = r"(?i)\(ARB[‐‑‒–—―\-]?[12](\s*&\s*ARB[‐-―\-]?2)?(\s+if\s+required)?\)"
TEMPLATE_PHRASE = r"(?i)(to\s+be\s+completed\s+by|required\s+for\s+ARB[‐-―\-]?[12]|click\s+to\s+read\s+message)"
GLOSSARY = r"(?i)\b(glossary|acronym|appendix|appendices|reference\s+links?|references)\b"
ACRONYM_ROW = r"^[A-Z]{2,6}\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,5}$"
SENTENCE_END = r"(?<!\d)[.!?](?:\s+|$)"
SENTENCE_WORDS = 8
FLOOR_STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "had", "has", "have", "was", "were", "been", "being", "from", "that",
    "this", "with", "which", "shall", "should", "must", "will", "may", "upon", "into", "onto", "also", "only", "such", "than", "then", "when",
    "where", "while", "these", "those", "their", "there", "them", "they", "because", "however", "therefore",
)

#: What a rule's anchor is bound to in a section, best first.
BINDINGS = "array<struct<text:string,similarity:double,char_start:int,char_length:int>>"
NUMBER = r"-?\d+(?:\.\d+)?"


def _blank(text: Column) -> Column:
    return F.coalesce(~F.regexp_like(text, F.lit(r"\S")), F.lit(True))


def regex_match(text: Column, pattern: str) -> Column:
    """Case-insensitive search, the dot matching line ends too; an empty or null text or pattern never matches."""
    re.compile(pattern)  # a bad pattern is an error of the rule, found before anything runs
    if not pattern:
        return F.lit(False)
    return F.coalesce((F.char_length(text) > 0) & F.regexp_like(text, F.lit("(?isU)" + pattern)), F.lit(False))


def phrase_match(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase stands in the text, whatever its case."""
    low = F.lower(text)
    hit = F.lit(False)
    for p in phrases:
        if p.strip():
            hit = hit | F.contains(low, F.lit(p.lower()))
    return F.coalesce(hit, F.lit(False))


def is_template_boilerplate(text: Column) -> Column:
    """A single placeholder phrase is enough."""
    return ~_blank(text) & phrase_match(text, list(BOILERPLATE))


def count_prose_sentences(text: Column) -> Column:
    """Sentences of SENTENCE_WORDS words or more."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: F.char_length(w) > 0))
    return F.when(_blank(text), 0).otherwise(F.size(F.filter(F.split(text, SENTENCE_END), lambda s: words(s) >= SENTENCE_WORDS)))


def is_review_scaffolding(text: Column) -> Column:
    hits = F.regexp_count(text, F.lit(REVIEW_TAG)) + F.regexp_count(text, F.lit(TEMPLATE_PHRASE))
    return ~_blank(text) & F.coalesce(hits >= 3, F.lit(False)) & (count_prose_sentences(text) <= 1)


def is_glossary_listing(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.char_length(x) > 0)
    heading = F.exists(lines, lambda x: F.regexp_like(x, F.lit(GLOSSARY)))
    rows = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(ACRONYM_ROW)) & ~F.regexp_like(x, F.lit(r"[\d%]"))))
    return ~_blank(text) & F.coalesce(heading | (rows >= 4), F.lit(False)) & (count_prose_sentences(text) <= 2)


def has_topic(topics: Column, scores: Column, topic: str, least: float | None = None) -> Column:
    """Membership, or with a positive ``least`` a score that reaches it; a topic without a score then fails."""
    member = F.coalesce(F.array_contains(topics, topic), F.lit(False))
    if least is None or least != least or least <= 0:
        return member
    return member & F.coalesce(F.try_element_at(scores, F.lit(topic)) >= least, F.lit(False))


def floor_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of three characters or more, stop words left out."""
    low = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_except(F.array_distinct(F.filter(low, lambda w: F.char_length(w) >= 3)), F.array(*(F.lit(w) for w in FLOOR_STOPWORDS)))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark; all of a text without one."""
    found = F.regexp_extract(text, r"(?s)^[^.!?]*[.!?]", 0)
    return F.trim(F.when(F.char_length(found) > 0, found).otherwise(text))


def number_near(text: Column, word: str, width: int) -> Column:
    """First number within ``width`` characters of the first place of ``word``; NaN without one."""
    at = F.locate(word.lower(), F.lower(text))
    around = F.substring(text, F.greatest(F.lit(1), at - width), F.lit(2 * width + len(word)))
    found = F.regexp_extract(around, NUMBER, 0)
    return F.when((at > 0) & (F.char_length(found) > 0), found.try_cast("double")).otherwise(F.lit(float("nan")))


def _around(text: Column, binding: Column, width: int) -> Column:
    w = max(1, min(width, 4096))
    lo = F.greatest(F.lit(0), binding["char_start"] - w)
    return F.substring(text, lo + 1, F.greatest(F.lit(0), binding["char_start"] + binding["char_length"] + w - lo))


def nearest_text(text: Column, bindings: Column, width: int = 40) -> Column:
    """The text up to ``width`` (1 to 4096) characters around the first binding; empty without one."""
    return F.when((F.char_length(text) > 0) & (F.size(bindings) > 0), _around(text, F.get(bindings, F.lit(0)), width)).otherwise("")


def number_near_bindings(text: Column, bindings: Column, width: int = 40) -> Column:
    """The first number around the first binding that has one; NaN without any."""
    found = F.filter(F.transform(bindings, lambda b: F.regexp_extract(_around(text, b, width), NUMBER, 0)), lambda x: F.char_length(x) > 0)
    return F.coalesce(F.when(F.char_length(text) > 0, F.get(found, F.lit(0)).try_cast("double")), F.lit(float("nan")))


def anchor_span(bindings: Column, anchor: str, text: Column | None = None) -> Column:
    """The best binding: most similar, then first, then least text; without one, if a text is given, the first place where
    the anchor's name stands in it as a word, whatever the case, with similarity 1; null without either."""
    best = F.get(F.array_sort(bindings, lambda a, b: F.when(a["similarity"] != b["similarity"], F.when(a["similarity"] > b["similarity"], -1).otherwise(1))
                              .when(a["char_start"] != b["char_start"], F.when(a["char_start"] < b["char_start"], -1).otherwise(1))
                              .when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)), F.lit(0))
    if text is None or not anchor:
        return best
    pattern = r"(?iU)\b" + re.escape(anchor) + r"\b"
    at = F.regexp_instr(text, F.lit(pattern))
    literal = F.when(at > 0, F.struct(F.regexp_extract(text, pattern, 0).alias("text"), F.lit(1.0).alias("similarity"), (at - 1).cast("int").alias("char_start"), F.lit(len(anchor)).alias("char_length")))
    return F.coalesce(best, literal)


def format_number(value: Column) -> Column:
    """Up to four decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", value.cast("double")), r"\.?0+$", "")
