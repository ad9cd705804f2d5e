"""Projections of raw catalog rows into market snapshots, and predicates on them, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinbook.functions.pricing import complement_side, is_valid_level, parse_side

# Forms of titles that bundle several outcomes, or only report statistics.
BUNDLE_PREFIX, STATS_ONLY = "MVE", r"(?i)\b(?:stat line|box score|stats only)\b"
BUNDLE_TITLE, BOTH = r"(?i)^(?:yes|no) [^,]+,\s*(?:yes|no) ", r"(?i)\band will\b"


def market_title(title: Column, subtitle: Column) -> Column:
    """A market's title with its own outcome behind it, unless the title has it already."""
    title, subtitle = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, subtitle))
    adds = (subtitle != "") & ~F.contains(F.lower(title), F.lower(subtitle))
    return F.when(adds, F.trim(F.concat(title, F.lit(" "), subtitle))).otherwise(title)


def hold_reason(ticker: Column, title: Column) -> Column:
    """Why an event is kept out of matching: 'mve', 'parlay_title', 'stats_only', or null; the first that holds."""
    title = F.coalesce(title, F.lit(""))
    return (
        F.when(F.startswith(F.upper(F.coalesce(ticker, F.lit(""))), F.lit(BUNDLE_PREFIX)), "mve")
        .when(title.rlike(BUNDLE_TITLE), "parlay_title").when(title.rlike(STATS_ONLY), "stats_only")
    )


def is_parlay(title: Column) -> Column:
    """A market of several conditions: by its form, three wins or more, or a second "will"."""
    title = F.coalesce(title, F.lit(""))
    wins = F.size(F.regexp_extract_all(title, F.lit(r"(?i)(\bwin\b)"), F.lit(1)))
    return title.rlike(BUNDLE_TITLE) | (wins >= 3) | title.rlike(BOTH)


def event_close(own: Column, markets: Column) -> Column:
    """An event's close: its own, or else the latest of its markets'."""
    return F.coalesce(own, F.array_max(markets))


def event_series(series: Column, ticker: Column) -> Column:
    """An event's series: its own, or else what stands before the ticker's first hyphen."""
    return F.coalesce(F.nullif(series, F.lit("")), F.substring_index(F.coalesce(ticker, F.lit("")), "-", 1))


def is_stale(end: Column, start: Column, now: Column) -> Column:
    """Ended over a day ago, and no game that is still to start."""
    return F.coalesce(end < now - F.expr("interval 1 day"), F.lit(False)) & ~F.coalesce(start >= now, F.lit(False))


def full_book(yes_bids: Column, no_bids: Column) -> Column:
    """A book from both outcomes' bids, as [price, size] strings: asks are 1 - the other outcome's bids, best first."""
    return F.struct(parse_side(yes_bids, bids=True).alias("bids"), complement_side(parse_side(no_bids, bids=True)).alias("asks"))


def inline_book(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """A book of the quotes that a catalog row has inline: prices outside (0, 1) are none, an unknown size is 0."""
    def side(price: Column, size: Column) -> Column:
        level = F.struct(price.cast("double").alias("price"), F.coalesce(size.cast("double"), F.lit(0.0)).alias("size"))
        return F.when((price > 0) & (price < 1), F.array(level)).otherwise(F.array().cast("array<struct<price:double,size:double>>"))

    return F.struct(side(bid, bid_size).alias("bids"), side(ask, ask_size).alias("asks"))


def quote(value: Column) -> Column:
    """A price given as text; null if it is none."""
    return value.try_cast("double")


def catalog_edge(bid_a: Column, ask_a: Column, bid_b: Column, ask_b: Column) -> Column:
    """(edge, needs_fetch): the better gross edge of both directions, and whether a quote for either is missing."""
    one, two = bid_b - ask_a, bid_a - ask_b
    return F.struct(F.round(F.greatest(one, two), 6).alias("edge"), (one.isNull() | two.isNull()).alias("needs_fetch"))


def to_enrich(edge: Column, stale: Column, margin: float | None) -> Column:
    """Does a pair need live books? Without a margin all do; else those without a quote, stale ones, and those within the margin."""
    if margin is None:
        return F.lit(True)
    return edge["needs_fetch"] | F.coalesce(stale, F.lit(False)) | F.coalesce(edge["edge"] >= -margin, F.lit(False))


def token_for(side: Column, labels: Column, tokens: Column) -> Column:
    """The token whose outcome has the side's name, else that at its place (yes first)."""
    at = F.array_position(F.transform(labels, F.lower), F.lower(side))
    return F.when(at > 0, F.get(tokens, (at - 1).cast("int"))).otherwise(F.get(tokens, F.when(F.lower(side) == "yes", 0).otherwise(1)))


def pair_key(ticker: Column, token: Column, market: Column) -> Column:
    """The key of a pair: the one venue's ticker, and the other's token or else id."""
    other = F.coalesce(F.nullif(token, F.lit("")), market, F.lit(""))
    return F.concat(F.coalesce(ticker, F.lit("")), F.lit("|"), other)


def net_of(accurate: Column, legacy: Column) -> Column:
    """The exact net, or else the older one."""
    return F.coalesce(accurate, legacy)


def keywords(title: Column, most: int = 4) -> Column:
    """Search words of a title, ``most`` of them: its names of two words or more, else its three longest words."""
    names = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 3)
    return F.slice(F.when(F.size(names) > 0, F.array_distinct(names)).otherwise(longest), 1, most)


def coverage_line(line: Column) -> Column:
    """(venue, ingested, open, pct, sweep, partial) of a coverage line of the log; null if it is none."""
    form = r"\[coverage\] (\w+): ([\d,]+)/([\d,]+) \((n/a|[\d.]+%)\) sweep=(\w+)"
    part = lambda k: F.regexp_extract(line, form, k)
    number = lambda k: F.regexp_replace(part(k), ",", "").cast("long")
    out = F.struct(
        part(1).alias("venue"), number(2).alias("ingested"), number(3).alias("open"), F.rtrim(F.regexp_replace(part(4), "%", "")).try_cast("double").alias("pct"),
        part(5).alias("sweep"), F.contains(line, F.lit("[PARTIAL CATALOG]")).alias("partial"),
    )
    return F.when(line.rlike(form), out)


def coverage_degraded(coverage: Column) -> Column:
    """A partial catalog, a sweep that failed in part or whole, or less than everything."""
    return coverage["partial"] | coverage["sweep"].isin("partial", "failed") | F.coalesce(coverage["pct"] < 100, F.lit(False))


def miss_state(created: Column, began: Column) -> Column:
    """A market that was missed: 'drift' if it came after the scan began, else (also if unknown) 'gap'."""
    return F.when(created > began, "drift").otherwise("gap")


def percent(n: Column, of: Column) -> Column:
    """A share as text with one place, n/a of nothing."""
    return F.when(of > 0, F.format_string("%.1f%%", 100 * n / of)).otherwise("n/a")


def valid_levels(levels: Column) -> Column:
    """Levels with a price inside (0, 1) and a size."""
    return F.filter(levels, lambda x: is_valid_level(x["price"], x["size"]))
