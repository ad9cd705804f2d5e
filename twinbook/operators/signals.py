"""Signals: gate, rank, horizon and review queue of priced pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinbook.functions.dates import annualised


def compute_signals(pairs: DataFrame, least: float, most: float, by_depth: bool = False, endorsed_only: bool = True) -> DataFrame:
    """Best candidate of each pair (pair, endorsed, risk, candidates: array of (direction, net, exec_net)).

    The gate value is exec_net or net; the best candidate by gate (the first of
    ties) stays if least <= gate <= most. Pairs at risk, and pairs that are not
    endorsed (null included), are left out.
    """
    rows = pairs.where("not coalesce(risk, false)")
    if endorsed_only:
        rows = rows.where("endorsed <=> true")
    rows = rows.select("pair", F.posexplode("candidates").alias("place", "c")).select("pair", "place", "c.*")
    rows = rows.withColumn("gate", F.col("exec_net" if by_depth else "net")).where("gate is not null")
    w = W.partitionBy("pair").orderBy(F.desc("gate"), "place")
    return rows.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & F.col("gate").between(least, most)).drop("rn", "place")


def settle_days(now: str):
    """Days from ``now`` to the later of two dates close_a and close_b; null if unknown or more than a day ago; at least 1."""
    last = F.greatest("close_a", "close_b")
    days = F.datediff(last, F.lit(now).cast("date"))
    return F.when(days >= -1, F.greatest(days, F.lit(1)))


def ranked(signals: DataFrame, now: str, n: int = 0) -> DataFrame:
    """Signals (key, net, close_a, close_b) by annualised net, with days and a 1-based rank; n 0 keeps all."""
    rows = signals.withColumn("days", settle_days(now)).withColumn("annualised", annualised(F.col("net"), F.col("days")))
    if n:
        rows = rows.orderBy(F.desc_nulls_last("annualised"), F.desc_nulls_last("net"), "key").limit(n)
    return rows


def yield_metrics(signals: DataFrame, now: str) -> DataFrame:
    """``signals`` (contracts, cost, profit, close_a, close_b) with roc, days and the compound annual yield of 30 days or more."""
    roc = F.when(F.col("cost") > 0, F.col("profit") / F.col("cost"))
    days = F.greatest(F.datediff(F.greatest("close_a", "close_b"), F.lit(now).cast("date")).cast("double"), F.lit(0.5))
    rows = signals.withColumn("roc", roc).withColumn("days", days)
    return rows.withColumn("annual_yield", F.when(F.col("days") >= 30, F.pow(1 + F.col("roc"), 365 / F.col("days")) - 1))


def signal_digest(log: DataFrame) -> DataFrame:
    """Per key: signals, best net, latest net and time; of equal times the later line is the latest."""
    return log.groupBy("key").agg(
        F.count("*").alias("signals"), F.max("net").alias("best"), F.max_by("net", F.struct("ts", "line_no")).alias("latest"), F.max("ts").alias("latest_ts")
    )
