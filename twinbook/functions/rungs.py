"""Labels of cumulative rungs ("Republicans, 26+ pts") and of range buckets ("Democrat 10-15%"), as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells that an event is such a race, and the sides that labels name in several ways.
RACE = "margin of victory"
SIDES = (("republican", r"\brepublicans?\b|\bgop\b"), ("democrat", r"\bdemocrats?\b|\bdemocratic\b|\bdem\b"))
INFINITY = float("inf")


def race_key(title: Column) -> Column:
    """A race's name as both venues share it: without years, articles and what says that it is a margin."""
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), rf"\s*(?:election\s+)?{RACE}.*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(the|20\d\d)\b", " "), r"\s+", " "))


def side(label: Column) -> Column:
    """The party that a label names, else its letters."""
    low = F.lower(label)
    named = F.coalesce(*(F.when(low.rlike(pattern), name) for name, pattern in SIDES))
    return F.coalesce(named, F.trim(F.regexp_replace(low, "[^a-z ]", "")))


def rung(label: Column, floor: Column) -> Column:
    """Struct (side, threshold) of a label like "Republicans, 26+ pts"; the strike counts before the label's number; else null."""
    pattern = r"^(.+?),\s*(\d+(?:\.\d+)?)\s*\+"
    stated = F.regexp_extract(label, pattern, 2).try_cast("double")
    return F.when(label.rlike(pattern), F.struct(side(F.regexp_extract(label, pattern, 1)).alias("side"), F.coalesce(floor, stated).alias("threshold")))


def bucket(label: Column) -> Column:
    """Struct (side, lo, hi) of "A 10-15%", "A 30%+", "A <5%" or "A wins"; else null."""
    label, number = F.trim(label), r"(\d+(?:\.\d+)?)"
    pattern = rf"^(.+?)(?:\s*{number}\s*[-–]\s*{number}\s*%?|\s*{number}\s*%?\s*\+|\s*<\s*{number}\s*%?|\s+(?i:wins?))$"
    part = lambda i: F.regexp_extract(label, pattern, i).try_cast("double")
    ends = F.coalesce(part(2), part(4), F.lit(0.0)).alias("lo"), F.coalesce(part(3), part(5), F.lit(INFINITY)).alias("hi")
    return F.when(label.rlike(pattern), F.struct(side(F.regexp_extract(label, pattern, 1)).alias("side"), *ends))
