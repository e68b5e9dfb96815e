"""Numbers that a clause states: durations, percentages and amounts, as array columns.

All patterns ignore case and work on whole texts inside the JVM; arrays are ascending and
distinct, scalars are 0 where nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and number words that define what counts as a figure ----
DAY = r"(?i)\b(\d{1,4})[\s-]*(?:calendar\s+|business\s+|working\s+)?days?\b"
MONTH = r"(?i)\b(\d{1,3})\s*(?:calendar\s+)?months?\b"
YEAR = r"(?i)\b(\d{1,3})\s*(?:calendar\s+|fiscal\s+)?years?\b"
DAY_WORDS = (
    r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|forty[\s-]?five|sixty|ninety|"
    r"one\s+hundred(?:[\s-]?and[\s-]?(?:twenty|eighty))?)\s+(?:calendar\s+|business\s+|working\s+)?days?\b")
MONTH_WORDS = r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|eighteen|twenty[\s-]?four|thirty[\s-]?six)\s+(?:calendar\s+)?months?\b"
YEAR_WORDS = (
    r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    r"twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|one\s+hundred)\s+(?:calendar\s+|fiscal\s+)?years?\b")
PERCENT = r"(?i)(\d{1,3}(?:\.\d{1,4})?)\s*%(?:\s*per\s+(month|annum|year))?"
#: A unit counts as a whole word only, and no look ahead behind the number makes it shorter than it stands: CAD463aef states 463, not 46.
DOLLAR = r"(?i)(?:\$|USD\s*\$?|CAD\s*\$?|US\$|CAD\$)\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?)\s*((?:million|billion|[mbk])(?![0-9A-Za-z_]))?"
DOLLAR_WORDS = r"(?i)(\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?)\s*(million|billion)\s*(?:dollars|USD|CAD)"
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "one hundred": 100, "twenty four": 24, "thirty six": 36,
    "forty five": 45, "one hundred and twenty": 120, "one hundred and eighty": 180,
}
#: Feature name to what must stand in the same clause; the first alternative of ``cyber`` has a boundary
#: on its left only, the last on its right only.
DOLLAR_TOPICS = {
    "cyber": r"(?i)\bcyber|network\s+security|privacy\s+liability\b",
    "gcl": r"(?i)\b(general\s+commercial\s+liability|general\s+liability|GCL|commercial\s+liability)\b",
    "professional": r"(?i)\bprofessional\s+(?:liability|indemnity|errors)\b",
}
DAY_TOPICS = {"payment": r"(?i)\b(pay|paid|payment|invoice|net)\b", "notice": r"(?i)\b(notice|terminat|written)\b"}
CLAUSE_CHARS = 200


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def _bare(number: Column) -> Column:
    return F.regexp_replace(number, "[, ]", "")


def counts(text: Column, digits: str, words: str) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, int(v))))
    stated = F.transform(_all(text, digits), lambda v: v.cast("bigint"))
    spelled = F.transform(_all(text, words), lambda v: F.try_element_at(table, F.regexp_replace(F.lower(v), r"[\s-]+", " ")).cast("bigint"))
    return _distinct(F.concat(stated, spelled))


def percents(text: Column) -> Column:
    return _distinct(F.transform(_all(text, PERCENT), lambda v: F.bround(v.cast("double"), 4)))


def percents_per_month(text: Column) -> Column:
    """Percentages with yearly ones divided by 12; those without a unit count as monthly."""
    pairs = F.arrays_zip(_all(text, PERCENT).alias("v"), _all(text, PERCENT, 2).alias("u"))
    rate = lambda p: F.when(F.lower(p["u"]).isin("annum", "year"), p["v"].cast("double") / 12.0).otherwise(p["v"].cast("double"))
    return _distinct(F.transform(pairs, lambda p: F.bround(rate(p), 4)))


def _amounts(text: Column) -> Column:
    def scaled(pattern):
        pairs = F.arrays_zip(_all(text, pattern).alias("v"), _all(text, pattern, 2).alias("u"))
        by = lambda p: F.when(F.lower(p["u"]) == "k", 1e3).when(F.lower(p["u"]).isin("m", "million"), 1e6).when(F.lower(p["u"]).isin("b", "billion"), 1e9).otherwise(1.0)
        return F.transform(pairs, lambda p: F.bround(_bare(p["v"]).try_cast("double") * by(p)).cast("bigint"))

    return F.concat(scaled(DOLLAR), scaled(DOLLAR_WORDS))


def dollars(text: Column) -> Column:
    return _distinct(_amounts(text))


def clauses(text: Column) -> Column:
    """Lines, and the sentences of lines of CLAUSE_CHARS or more; empty ones left out."""
    split = F.transform(F.split(text, "\n"), lambda x: F.when(F.char_length(x) < CLAUSE_CHARS, F.array(x)).otherwise(F.split(x, r"(?<=[.!?])\s+")))
    return F.filter(F.flatten(split), lambda x: F.char_length(x) > 0)


def best_in_clauses(text: Column, topic: str, values) -> Column:
    """Greatest figure in a clause that also speaks of the topic; 0 if there is none."""
    own = F.filter(clauses(text), lambda x: F.regexp_like(x, F.lit(topic)))
    return F.coalesce(F.array_max(F.flatten(F.transform(own, values))), F.lit(0).cast("bigint"))


def _ends(values: Column, kind: str) -> tuple[Column, Column]:
    zero = F.lit(0).cast(kind)
    return F.coalesce(F.array_min(values), zero), F.coalesce(F.array_max(values), zero)


def text_features(text: Column) -> dict[str, Column]:
    """Every feature of a text by name; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    arrays = {
        "day_counts": counts(text, DAY, DAY_WORDS), "month_counts": counts(text, MONTH, MONTH_WORDS), "year_counts": counts(text, YEAR, YEAR_WORDS),
        "percent_values": percents(text), "dollar_amounts": dollars(text),
    }
    out = dict(arrays)
    for name in ("day_count", "month_count", "year_count"):
        out[f"{name}_min"], out[f"{name}_max"] = _ends(arrays[f"{name}s"], "bigint")
    out["percent_min"], out["percent_max"] = _ends(arrays["percent_values"], "double")
    out["percent_min_per_month"], out["percent_max_per_month"] = _ends(percents_per_month(text), "double")
    out["dollar_min"], out["dollar_max"] = _ends(arrays["dollar_amounts"], "bigint")
    for key, topic in DOLLAR_TOPICS.items():
        out[f"dollar_for_{key}"] = best_in_clauses(text, topic, _amounts)
    for key, topic in DAY_TOPICS.items():
        out[f"day_count_for_{key}"] = best_in_clauses(text, topic, lambda x: F.transform(_all(x, DAY), lambda v: v.cast("bigint")))
    return out
