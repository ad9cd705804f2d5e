"""Funnels, group statistics, plausibility bands and top rows of priced pairs.

A pair's ``net`` is null while unpriced, and negative where priced without profit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbook.functions.pricing import exact_sum

#: A net above this is taken for a mismatch rather than an opportunity.
PLAUSIBLE = 0.10
EDGES = {"over_1": 0.01, "over_3": 0.03, "over_5": 0.05, "over_10": 0.10}


def funnel(pairs: DataFrame, populations: dict[str, Column]) -> DataFrame:
    """One row per population: total, priced, positive and counts above each edge. One pass over the pairs."""
    member = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in populations.items())))
    rows = pairs.select(F.explode(member).alias("population"), "net", "net_flat")
    return rows.groupBy("population").agg(
        F.count("*").alias("total"), F.count("net").alias("priced"), F.count_if(F.col("net") > 0).alias("positive"),
        F.count_if(F.col("net_flat") > 0).alias("positive_flat"),
        *(F.count_if(F.col("net") > edge).alias(name) for name, edge in EDGES.items()),
    )


def group_stats(pairs: DataFrame, key: Column) -> DataFrame:
    """Per key: pairs, priced, positive, positive_plausible, best_edge and executable profit of plausible pairs."""
    plausible = (F.col("net") > 0) & (F.col("net") <= PLAUSIBLE)
    return pairs.groupBy(key.alias("key")).agg(
        F.count("*").alias("pairs"), F.count("net").alias("priced"), F.count_if(F.col("net") > 0).alias("positive"),
        F.count_if(plausible).alias("positive_plausible"), F.max("net").alias("best_edge"),
        F.coalesce(exact_sum(F.when(plausible, F.col("exec_profit"))), F.lit(0.0)).alias("exec_profit"),
    )


def plausibility(pairs: DataFrame) -> DataFrame:
    """Positive pairs by band: count, those with depth, and their profit."""
    rows = pairs.where("net > 0").withColumn("band", F.when(F.col("net") <= PLAUSIBLE, "plausible").otherwise("implausible"))
    return rows.groupBy("band").agg(F.count("*").alias("pairs"), F.count("exec_profit").alias("with_depth"), F.coalesce(exact_sum(F.col("exec_profit")), F.lit(0.0)).alias("profit"))


def top_rows(pairs: DataFrame, by: list[Column], n: int = 15) -> DataFrame:
    """The first n rows of a total order."""
    return pairs.orderBy(*by).limit(n)


def coverage_ledger(markets: DataFrame) -> DataFrame:
    """Per family: total, held_out, matched, and whether it never, partly or fully matches."""
    out = markets.groupBy("family").agg(
        F.count("*").alias("total"), F.count_if("excluded").alias("held_out"), F.count_if("matched").alias("matched")
    )
    state = F.when(F.col("matched") == 0, "never").when(F.col("matched") < F.col("total") - F.col("held_out"), "partly").otherwise("fully")
    return out.withColumn("state", state)


def event_cap(events: DataFrame, order: list[Column], cap: int, always: Column) -> DataFrame:
    """The first ``cap`` events in order, and those that are always included."""
    first = events.orderBy(*order).limit(cap)
    return first.unionByName(events.where(always).join(first.select("event"), "event", "left_anti"))
