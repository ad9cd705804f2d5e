"""Ingestion of a venue's catalog with its accounting: every market is ingested, or excluded for one reason.

Counts are observed in the pass that ingests (``Observation``), so that no
second scan makes them, and they always add up to the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from twinbook.functions.snapshots import hold_reason, is_parlay

# A status that is open, reasons of exclusion in their order, and reasons to hold a market out of matching.
OPEN = "active"
REASONS = ("event_closed", "category", "horizon", "event_cap", "orphan_known", "status")
HOLDS = ("mve", "parlay_title", "stats_only", "parlay_market")


def classified(markets: DataFrame, began: str, category: str | None = None, horizon: str | None = None, most_events: int | None = None) -> DataFrame:
    """``markets`` (market_id, event_id, status, title, ticker, event_title, event_close, category) with ``excluded`` and ``match_excluded``.

    ``excluded`` is the first reason that holds, null for ingested markets: the
    event's close lies before ``began``, another category, a close beyond the
    horizon, an event beyond the ``most_events`` that close first, a status that
    is not open. ``match_excluded`` holds ingested markets out of matching only.
    """
    close = F.col("event_close").cast("timestamp")
    late = F.coalesce(close > F.lit(horizon).cast("timestamp"), F.lit(False)) if horizon else F.lit(False)
    other = F.coalesce(F.lower("category") != category.lower(), F.lit(True)) if category and category != "all" else F.lit(False)
    reason = F.when(F.coalesce(close < F.lit(began).cast("timestamp"), F.lit(False)), "event_closed").when(other, "category").when(late, "horizon")
    rows = markets.withColumn("excluded", reason)
    if most_events is not None:
        # The events that close first; ties by id. The limit keeps a bounded number of ids.
        first = rows.where("excluded is null").groupBy("event_id").agg(F.min("event_close").alias("event_close")).orderBy(F.col("event_close").asc_nulls_last(), "event_id").limit(most_events)
        rows = rows.join(first.select("event_id", F.lit(True).alias("first")), "event_id", "left")
        rows = rows.withColumn("excluded", F.coalesce("excluded", F.when(F.col("first").isNull(), "event_cap"))).drop("first")
    rows = rows.withColumn("excluded", F.coalesce("excluded", F.when(F.coalesce(F.col("status") != OPEN, F.lit(True)), "status")))
    held = F.coalesce(hold_reason(F.col("ticker"), F.col("event_title")), F.when(is_parlay(F.col("title")), "parlay_market"))
    return rows.withColumn("match_excluded", F.when(F.col("excluded").isNull(), held))


def with_orphans(markets: DataFrame, sweep: DataFrame) -> DataFrame:
    """``markets`` with ``orphan`` false, and those of a direct ``sweep`` of all open markets (same columns) with ``orphan`` true.

    A swept market is an orphan only if the catalog has neither it nor its event;
    others are ``known``, and counted as such.
    """
    # One row for each id, so that a repeated catalog row does not repeat a swept one.
    known_id = markets.select("market_id").distinct().withColumn("m", F.lit(True))
    known_event = markets.select("event_id").distinct().withColumn("e", F.lit(True))
    swept = sweep.join(known_id, "market_id", "left").join(known_event, "event_id", "left").withColumn("known", F.coalesce("m", "e", F.lit(False))).drop("m", "e")
    return markets.withColumns({"orphan": F.lit(False), "known": F.lit(False)}).unionByName(swept.withColumn("orphan", F.lit(True)))


def _counts(orphans: bool) -> list[Column]:
    ours = ~F.col("orphan") if orphans else F.lit(True)
    out = [F.count_if(ours).alias("catalog"), F.count_if(F.col("excluded").isNull()).alias("ingested"), F.count_if(F.col("match_excluded").isNotNull()).alias("held_out"), F.count_if(~ours).alias("orphan_scanned")]
    out += [F.count_if(F.col("excluded") == r).alias(f"excluded_{r}") for r in REASONS]
    return out + [F.count_if(F.col("match_excluded") == h).alias(f"held_{h}") for h in HOLDS]


def ingest(markets: DataFrame, began: str, sweep: DataFrame | None = None, **filters) -> tuple[DataFrame, Observation]:
    """(snapshots, counts): the ingested markets with ``match_excluded``, and what is counted while they are read once.

    ``counts.get`` waits for the first action on the snapshots. Take care that
    this reads all of them: a limit or a filter above would count a part.
    """
    rows = markets if sweep is None else with_orphans(markets, sweep)
    rows = classified(rows, began, **filters)
    if sweep is not None:
        rows = rows.withColumn("excluded", F.when(F.col("known"), "orphan_known").otherwise(F.col("excluded"))).withColumn("match_excluded", F.when(~F.col("known"), F.col("match_excluded")))
    counts = Observation("ingest")
    return rows.observe(counts, *_counts(sweep is not None)).where("excluded is null").drop("excluded", "known"), counts


def balanced(counts: dict[str, int]) -> bool:
    """Do ingested and excluded markets add up to the catalog and what the sweep brought?"""
    return counts["ingested"] + sum(counts[f"excluded_{r}"] for r in REASONS) == counts["catalog"] + counts["orphan_scanned"]
