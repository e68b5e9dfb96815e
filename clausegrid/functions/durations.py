"""Recurring durations: phrases to ISO 8601 and whole days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: phrases and the days of their cycle ----
PHRASES = {
    "every 30 days": 30, "every thirty (30) days": 30, "on a 30-day cycle": 30, "monthly": 30, "every month": 30,
    "every 60 days": 60, "every sixty (60) days": 60, "on a 60-day cycle": 60, "bi-monthly": 60, "bimonthly": 60,
    "every 90 days": 90, "every ninety (90) days": 90, "on a 90-day cycle": 90, "on a 90 day cycle": 90, "quarterly": 90, "every quarter": 90,
    "every 180 days": 180, "on a 180-day cycle": 180, "semi-annually": 180, "semiannually": 180, "every six months": 180, "every 6 months": 180,
    "every 365 days": 365, "on a 365-day cycle": 365, "annually": 365, "yearly": 365, "every year": 365,
    "every 730 days": 730, "biennially": 730, "every two years": 730, "every 2 years": 730,
}
EVERY_N = r"(?i)^\s*every\s+(\d{1,4})[\-\s]?day"
ON_N = r"(?i)^\s*on\s+a\s+(\d{1,4})[\-\s]?day\b"
ISO = r"(?i)^P(?:(\d+)W|(\d+)D)$"


def canonical(phrase: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(phrase), r"[.,;]+$", ""), r"\s+", " ")


def to_days(phrase: Column) -> Column:
    """Whole days of a phrase or of an ISO duration in days or weeks; null if neither."""
    low = F.lower(canonical(phrase))
    table = F.create_map(*(F.lit(x) for entry in PHRASES.items() for x in entry))
    number = lambda pattern, text, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")
    positive = lambda n: F.when(n > 0, n)
    spoken = F.coalesce(F.try_element_at(table, low), positive(number(EVERY_N, low)), positive(number(ON_N, low)))
    iso = F.trim(phrase)
    looks = (F.char_length(phrase) >= 3) & F.lower(F.substring(phrase, 1, 1)).eqNullSafe("p")
    return F.when(looks, F.coalesce(number(ISO, iso, 1) * 7, number(ISO, iso, 2))).otherwise(spoken)


def to_iso(phrase: Column) -> Column:
    days = to_days(phrase)
    return F.when(days.isNotNull(), F.concat(F.lit("P"), days.cast("string"), F.lit("D")))
