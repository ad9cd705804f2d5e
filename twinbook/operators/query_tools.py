"""Parameterised read queries over stored scans: checked arguments in, rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORTS = {"net": [F.desc_nulls_last], "profit": [F.desc_nulls_last], "contracts": [F.desc_nulls_last], "days": [F.asc_nulls_last]}
MOST = 50


@dataclass(frozen=True)
class Search:
    """Arguments of ``search_pairs``; None leaves a filter out."""

    category: str | None = None
    text: str | None = None
    min_net: float | None = None
    max_net: float | None = None
    min_profit: float | None = None
    max_days: float | None = None
    flagged: bool | None = None
    sort: str = "net"
    limit: int = 20

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {sorted(SORTS)}")


def search_pairs(pairs: DataFrame, args: Search) -> DataFrame:
    """Rows (key, title, category, net, profit, contracts, days, flagged) with total_candidates.

    total_candidates counts what all filters but that on flags let through; the
    limit, at most 50, applies after that one.
    """
    rows = pairs
    for value, test in (
        (args.category, lambda v: F.col("category") == v), (args.text, lambda v: F.contains(F.lower("title"), F.lit(v.lower()))),
        (args.min_net, lambda v: F.col("net") >= v), (args.max_net, lambda v: F.col("net") <= v),
        (args.min_profit, lambda v: F.col("profit") >= v), (args.max_days, lambda v: F.col("days") <= v),
    ):
        if value is not None:
            rows = rows.where(test(value))
    total = rows.count()
    if args.flagged is not None:
        rows = rows.where(F.col("flagged").eqNullSafe(args.flagged))
    order = SORTS[args.sort][0](args.sort)
    return rows.orderBy(order, "key").limit(max(1, min(MOST, args.limit))).withColumn("total_candidates", F.lit(total))


def pair_history(scans: DataFrame, key: str) -> DataFrame:
    """A pair's net over the scans (scan_id, key, net), with the change since the one before."""
    rows = scans.where(F.col("key") == key)
    return rows.withColumn("change", F.expr("net - lag(net) over (partition by key order by scan_id)"))


def latest_scan_of(scans: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The row of a pair in the newest completed scan that has it."""
    done = scans.where("status = 'completed'").select("scan_id")
    rows = pairs.where(F.col("key") == key).join(done, "scan_id")
    return rows.orderBy(F.desc("scan_id")).limit(1)
