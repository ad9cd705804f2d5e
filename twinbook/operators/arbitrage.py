"""Two-leg opportunities from best quotes, and the signals among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinbook.functions.pricing import taker_fee


def directions(quotes: DataFrame) -> DataFrame:
    """Both directions of each pair of quotes (pair, bid_a, ask_a, bid_b, ask_b): gross, fee and net.

    'a_yes': buy YES on a and NO on b; 'b_yes': buy YES on b and NO on a. A
    direction with a missing quote is left out. The fee is due on venue b.
    """
    one = lambda name, yes, no, fee_at: F.struct(F.lit(name).alias("direction"), yes.alias("cost_yes"), (1 - no).alias("cost_no"), taker_fee(fee_at).alias("fee"))
    both = F.array(
        one("a_yes", F.col("ask_a"), F.col("bid_b"), 1 - F.col("bid_b")), one("b_yes", F.col("ask_b"), F.col("bid_a"), F.col("ask_b"))
    )
    rows = quotes.select("pair", F.posexplode(both).alias("order", "d")).select("pair", "order", "d.*")
    rows = rows.where("cost_yes is not null and cost_no is not null")
    gross = F.round(1 - F.col("cost_yes") - F.col("cost_no"), 6)
    return rows.withColumn("gross", gross).withColumn("net", F.round(F.col("gross") - F.col("fee"), 6))


def find_arb(quotes: DataFrame, least: float = 0.0) -> DataFrame:
    """Directions whose net is at least ``least`` (0 keeps break-even)."""
    return directions(quotes).where(F.col("net") >= least)


def best_direction(quotes: DataFrame) -> DataFrame:
    """Each pair's direction of greatest net; the first of ties."""
    w = W.partitionBy("pair").orderBy(F.desc("net"), "order")
    return directions(quotes).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "order")


def flip(quotes: DataFrame, inverted: str) -> DataFrame:
    """Venue b's quotes of inverted pairs, turned into those of the other outcome."""
    bid = F.when(F.col(inverted), F.round(1 - F.col("ask_b"), 6)).otherwise(F.col("bid_b"))
    ask = F.when(F.col(inverted), F.round(1 - F.col("bid_b"), 6)).otherwise(F.col("ask_b"))
    return quotes.withColumns({"bid_b": bid, "ask_b": ask})
