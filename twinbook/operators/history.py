"""Scans over time: latest rows, first-wins dedupe, differences, retention, re-alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinbook.dealing import dealt


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in ``order``; one aggregation, without sorting groups."""
    held = F.struct(*order, *(c for c in rows.columns if c not in order and c not in keys))
    out = rows.groupBy(*keys).agg(F.max(held).alias("row"))
    return out.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rows.columns if c not in keys))


def dedupe_ranked(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """First-wins dedupe: the row of least rank for each key, ranks kept as they were."""
    w = W.partitionBy(key).orderBy(rank)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def compare_scans(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, net_before, net_after, delta) of scans (key, net): added, removed and changed keys."""
    a, b = before.select("key", F.col("net").alias("net_before"), F.lit(True).alias("was")), after.select("key", F.col("net").alias("net_after"), F.lit(True).alias("is"))
    both = a.join(b, "key", "full_outer")
    delta = F.round(F.col("net_after") - F.col("net_before"), 6)
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(delta != 0, "changed")
    return both.withColumns({"change": change, "delta": delta}).where("change is not null").select("key", "change", "net_before", "net_after", F.when(F.col("change") == "changed", F.col("delta")).alias("delta"))


def keep_newest(scans: DataFrame, group: list[str], order: Column, keep: int) -> DataFrame:
    """The newest ``keep`` scans of each group."""
    w = W.partitionBy(*group).orderBy(order)
    return scans.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def coverage_diff(ingested: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, state) of ids in one table only, as often as they are there: 'gap' (only in truth) or 'closed_since' (only ingested). A null id is no other's."""
    both = ingested.select("id", F.lit(True).alias("mine")).unionAll(truth.select("id", F.lit(False)))
    held = dealt(both, "id").groupBy("id").agg(F.count_if("mine").cast("int").alias("mine"), F.count_if(~F.col("mine")).cast("int").alias("real"))
    alone = lambda state, n, other: F.array_repeat(F.lit(state), F.when(F.col("id").isNull() | (F.col(other) == 0), F.col(n)).otherwise(0))
    return held.select("id", F.explode(F.concat(alone("gap", "real", "mine"), alone("closed_since", "mine", "real"))).alias("state"))


def realerts(signals: DataFrame, state: DataFrame, hours: float, improve: float) -> DataFrame:
    """Signals (key, net, ts) that are new, improved by ``improve``, or last sent ``hours`` or more ago."""
    rows = signals.join(state.select("key", F.col("net").alias("last_net"), F.col("ts").alias("last_ts")), "key", "left")
    reason = (
        F.when(F.col("last_net").isNull(), "new")
        .when(F.col("net") >= F.col("last_net") + improve - 1e-12, "improved")
        .when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp")) >= int(hours * 3_600_000_000), "due")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*signals.columns, "reason")


def coverage_report(ingested: DataFrame, truth: DataFrame, began: str) -> DataFrame:
    """One row (truth, ingested, gap, drift, closed_since, pct, clean) of ids (id) ingested and those there are (id, created).

    What is missing is drift if it was created after the scan began, else a gap.
    """
    both = ingested.select("id", F.lit(1).alias("mine")).join(truth.select("id", "created", F.lit(1).alias("real")), "id", "full_outer")
    missing = F.col("mine").isNull()
    drift = missing & F.coalesce(F.col("created") > F.lit(began).cast("timestamp"), F.lit(False))
    out = both.agg(
        F.count("real").alias("truth"), F.count("mine").alias("ingested"), F.count_if(missing & ~drift).alias("gap"), F.count_if(drift).alias("drift"), F.count_if(F.col("real").isNull()).alias("closed_since"),
        F.count_if(F.col("real").isNotNull() & F.col("mine").isNotNull()).alias("held"),
    )
    return out.withColumn("pct", F.when(F.col("truth") > 0, F.round(100 * F.col("held") / F.col("truth"), 4))).withColumn("clean", F.col("gap") == 0).drop("held")
