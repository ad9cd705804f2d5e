"""Baskets over price ladders: range joins, coverage checks, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinbook.functions.pricing import poisoned_sum

#: The fee's factor of the venue that lists rungs.
FEE = 0.07


def baskets(rungs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per rung (race, threshold): baskets of buckets (race, lo, hi, bid, ask) at or above it, and those that straddle it.

    ``above_ask`` and ``above_bid`` are null if a bucket of the basket has no quote, and so is ``sup_ask``, the price
    of all that reach above the threshold, straddling ones included.
    """
    pairs = rungs.join(buckets, "race").where(F.col("hi") > F.col("threshold"))
    above = F.col("lo") >= F.col("threshold")
    held = lambda c: F.when(F.count_if(above) == F.count(F.when(above, F.col(c))), F.sum(F.when(above, F.col(c))))
    return pairs.groupBy("race", "threshold").agg(
        F.count_if(above).alias("n_above"), F.count_if(~above).alias("n_straddle"), held("bid").alias("above_bid"), held("ask").alias("above_ask"), poisoned_sum(F.col("ask")).alias("sup_ask")
    )


def synthesize(rungs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each rung (race, side, threshold, id, title, bid, ask) beside the buckets (race, side, lo, hi, id, label, bid, ask) that replicate it.

    ``sub_legs`` lie at or above the threshold: they pay only when the rung does,
    so the rung may be bought and they be sold, for ``sub_bid``. ``sup_legs`` add
    those that straddle it; they pay whenever the rung does, and so may be bought
    for ``sup_ask``, if they leave no gap from their lowest end up to infinity.
    ``exact`` rungs have no straddling leg. A price is null if a leg has no
    quote; rungs without any price are left out. Legs stand by lo, hi and id.
    """
    keys = ["race", "side", "threshold", "id"]
    legs = buckets.select("race", "side", "lo", "hi", F.col("id").alias("leg"), "label", F.col("bid").alias("leg_bid"), F.col("ask").alias("leg_ask"))
    above = F.col("lo") >= F.col("threshold")
    rows = rungs.join(legs, ["race", "side"]).where(above | (F.col("hi") > F.col("threshold")))
    reach = F.max("hi").over(W.partitionBy(*keys).orderBy("lo", "hi", "leg").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"above": above, "gap": F.coalesce(reach < F.col("lo"), F.lit(False))})
    full = lambda price, over: F.when(F.count_if(over) == F.count_if(over & price.isNotNull()), F.sum(F.when(over, price)))
    leg = F.struct("lo", "hi", "leg", "label", "above")
    found = rows.groupBy(*keys).agg(
        F.first("title").alias("title"), F.first("bid").alias("bid"), F.first("ask").alias("ask"), F.count_if(~F.col("above")).alias("n_straddle"), F.count_if("above").alias("n_above"),
        full(F.col("leg_bid"), F.col("above")).alias("sub"), poisoned_sum(F.col("leg_ask")).alias("sup"), (~F.bool_or("gap") & (F.max("hi") == float("inf"))).alias("covered"), F.array_sort(F.collect_list(leg)).alias("legs"),
    )
    named = lambda legs, field: F.transform(legs, lambda x: x[field])
    found = found.select(
        *keys, "title", "bid", "ask", (F.col("n_straddle") == 0).alias("exact"), F.when(F.col("n_above") > 0, F.round("sub", 4)).alias("sub_bid"), F.when(F.col("covered"), F.round("sup", 4)).alias("sup_ask"),
        named(F.filter("legs", lambda x: x["above"]), "leg").alias("sub_legs"), named(F.col("legs"), "leg").alias("sup_legs"), named(F.col("legs"), "label").alias("leg_labels"),
    )
    return found.where(F.col("sub_bid").isNotNull() | F.col("sup_ask").isNotNull())


def edges(found: DataFrame, fee: float = FEE) -> DataFrame:
    """What ``synthesize`` found, with the better ``direction`` of each rung, its ``edge`` and its ``legs``; rungs without a quote are left out.

    'buy rung' sells the legs above it, 'sell rung' buys those that dominate it;
    each pays the rung's venue's fee of ``fee`` q (1 - q). The first of ties.
    """
    charge = lambda q: F.lit(fee) * q * (1 - q)
    buy = F.col("sub_bid") - F.col("ask") - charge(F.col("ask"))
    sell = F.col("bid") - F.col("sup_ask") - charge(1 - F.col("bid"))
    rows = found.withColumns({"_buy": buy, "_sell": sell}).where("_buy is not null or _sell is not null")
    first = F.coalesce(F.col("_buy") >= F.col("_sell"), F.col("_buy").isNotNull())
    rows = rows.withColumns({
        "edge": F.round(F.greatest("_buy", "_sell"), 4), "direction": F.when(first, "buy rung").otherwise("sell rung"), "legs": F.when(first, F.col("sub_legs")).otherwise(F.col("sup_legs")),
    })
    return rows.drop("_buy", "_sell")


def covers_tail(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: do the intervals (lo, hi) reach without a gap from the first to infinity?"""
    w = W.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("hi").over(w)
    gaps = legs.withColumn("gap", reach.isNotNull() & (reach < F.col("lo")))
    return gaps.groupBy(*keys).agg((~F.bool_or("gap") & (F.max("hi") == float("inf"))).alias("covered"))


def distribution(ladder: DataFrame) -> DataFrame:
    """(event, level, probability) from P(above level): differences of neighbours, cut at 0, first against 1."""
    w = W.partitionBy("event").orderBy("level")
    return ladder.select("event", "level", F.greatest(F.lit(0.0), F.lag("above", 1, 1.0).over(w) - F.col("above")).alias("probability"))


def monotonicity_violations(ladder: DataFrame) -> DataFrame:
    """Neighbouring levels, unpriced ones left out, where P(above) rises."""
    w = W.partitionBy("event").orderBy("level")
    rows = ladder.where("above is not null").select(
        "event", F.lag("level").over(w).alias("low"), F.col("level").alias("high"), F.lag("above").over(w).alias("p_low"), F.col("above").alias("p_high")
    )
    return rows.where("p_high > p_low")


def basket_price(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the legs' asks, null if one is missing."""
    return legs.groupBy(*keys).agg(poisoned_sum(F.col("ask")).alias("ask"), F.count("*").alias("legs"))
