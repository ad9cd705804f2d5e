"""Prices, fees and quotes of two-sided books, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = "struct<price:double,size:double>"
BOOK = f"struct<bids:array<{LEVEL}>,asks:array<{LEVEL}>>"


def taker_fee(price: Column) -> Column:
    """Fee per contract of the variable-fee venue: 0.07 p (1 - p), to four places."""
    return F.round(F.lit(0.07) * price * (1 - price), 4)


def is_valid_level(price: Column, size: Column) -> Column:
    return (price > 0) & (price < 1) & (size > 0)


def parse_side(levels: Column, bids: bool) -> Column:
    """Levels given as [price, size] strings: cast, drop invalid ones, best first."""
    cast = F.transform(levels, lambda x: F.struct(x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("size")))
    kept = F.filter(cast, lambda x: F.coalesce(is_valid_level(x["price"], x["size"]), F.lit(False)))
    ordered = F.array_sort(kept, lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).otherwise(0))
    return F.reverse(ordered) if bids else ordered


def complement_side(levels: Column) -> Column:
    """The other outcome's levels: price 1 - p, to six places."""
    return F.transform(levels, lambda x: F.struct(F.round(1 - x["price"], 6).alias("price"), x["size"].alias("size")))


def complement_book(book: Column) -> Column:
    return F.struct(complement_side(book["asks"]).alias("bids"), complement_side(book["bids"]).alias("asks"))


def best_bid(book: Column) -> Column:
    return F.get(book["bids"], F.lit(0))["price"]


def best_ask(book: Column) -> Column:
    return F.get(book["asks"], F.lit(0))["price"]


def mid(book: Column) -> Column:
    """Mean of both best quotes, null unless both are there."""
    return F.round((best_bid(book) + best_ask(book)) / 2, 6)


def spread(book: Column) -> Column:
    return F.round(best_ask(book) - best_bid(book), 6)


def poisoned_sum(x: Column) -> Column:
    """Sum that is null if any value is: a basket with a missing leg has no price."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def exact_sum(x: Column, places: int = 4) -> Column:
    """Sum of values on a decimal grid, free of rounding in any order of the rows."""
    return F.sum(F.round(x * 10**places).cast("long")) / F.lit(10.0**places)
