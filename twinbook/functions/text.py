"""Token sets and similarity of titles, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where ``value`` is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(title: Column, least: int = 1) -> Column:
    """Sorted distinct lower-case words of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= least)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by that of the union; 0 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def prefix_length(n: Column, threshold: float) -> Column:
    """Tokens, rarest first, among which sets of Jaccard ``threshold`` must share one."""
    if threshold <= 0:
        return n
    least = F.greatest(F.lit(1), F.least(n, n - F.ceil(F.lit(threshold) * n - 1e-9) + 1))
    return F.when(n <= 0, 0).otherwise(least)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def first_match(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The first label whose pattern occurs in the text."""
    out = None
    for label, pattern in cases:
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)
