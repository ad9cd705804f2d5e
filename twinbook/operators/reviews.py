"""Reviews, evidence and the review queue of a scan's pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.operators.vetoes import rule_flags


def current_reviews(reviews: DataFrame) -> DataFrame:
    """The latest review (by created_at, then id) of each pair_key."""
    return reviews.groupBy("pair_key").agg(F.max_by(F.struct("*"), F.struct("created_at", "id")).alias("r")).select("r.*")


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """The newest text of each (venue, market_id), by fetched_at, then content_hash."""
    return evidence.groupBy("venue", "market_id").agg(F.max_by(F.struct("*"), F.struct("fetched_at", "content_hash")).alias("r")).select("r.*")


def with_staleness(reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """``reviews`` (market_a, market_b, hash_a, hash_b) with stale: both hashes of a side are known and differ from the newest."""
    newest = latest_evidence(evidence)
    out = reviews
    for s in "ab":
        now = newest.where(F.col("venue") == s).select(F.col("market_id").alias(f"market_{s}"), F.col("content_hash").alias(f"now_{s}"))
        out = out.join(now, f"market_{s}", "left")
    differs = [F.coalesce(F.col(f"hash_{s}") != F.col(f"now_{s}"), F.lit(False)) for s in "ab"]
    return out.withColumn("stale", differs[0] | differs[1]).drop("now_a", "now_b")


def depth_economics(pairs: DataFrame) -> DataFrame:
    """``pairs`` (contracts, profit, roi) with capital = profit / roi; null unless all are known, and contracts and roi positive."""
    known = F.col("profit").isNotNull() & (F.col("contracts") > 0) & (F.col("roi") > 0)
    return pairs.withColumn("capital", F.when(known, F.round(F.col("profit") / F.col("roi"), 4)))


def review_queue(pairs: DataFrame, reviews: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` pairs (pair_key, net, exec_net, ...) to look at, with rank from 1, and the verdict of their latest review.

    By depth-backed net, or else net, then net, both descending, then key.
    """
    top = pairs.orderBy(F.desc_nulls_last(F.coalesce("exec_net", "net")), F.desc_nulls_last("net"), "pair_key").limit(top_n)
    place = F.expr("row_number() over (order by coalesce(exec_net, net) desc nulls last, net desc nulls last, pair_key)")
    # The window sees top_n rows at most.
    return top.withColumn("rank", place).join(current_reviews(reviews).select("pair_key", "verdict", "reviewer"), "pair_key", "left")


def with_rule_flags(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``pairs`` (market_a, market_b) with rule_flags of their newest settlement texts; null unless both are known."""
    newest = latest_evidence(evidence)
    out = pairs
    for s in "ab":
        text = newest.where(F.col("venue") == s).select(F.col("market_id").alias(f"market_{s}"), F.col("rules_text").alias(f"text_{s}"))
        out = out.join(text, f"market_{s}", "left")
    known = F.col("text_a").isNotNull() & F.col("text_b").isNotNull()
    return out.withColumn("rule_flags", F.when(known, rule_flags(F.col("text_a"), F.col("text_b")))).drop("text_a", "text_b")


def pairs_with_books(pairs: DataFrame, books: DataFrame) -> DataFrame:
    """``pairs`` of scans with their books, null where none is kept."""
    return pairs.join(books, ["scan_id", "pair_key"], "left")


def newest_scan_with(pairs: DataFrame, scans: DataFrame) -> DataFrame:
    """(pair_key, scan_id): the newest completed scan that holds each pair."""
    done = scans.where("status = 'completed'").select(F.col("id").alias("scan_id"))
    return pairs.join(done, "scan_id").groupBy("pair_key").agg(F.max("scan_id").alias("scan_id"))


def market_pairs(pairs: DataFrame, scans: DataFrame, side: str, limit: int = 5) -> DataFrame:
    """(market, pair_key, rank): each market's first ``limit`` pairs of the newest completed scan, nulls last."""
    newest = scans.where("status = 'completed'").agg(F.max("id").alias("scan_id"))
    rows = pairs.join(F.broadcast(newest), "scan_id").withColumn("market", F.col(f"market_{side}"))
    place = F.expr("row_number() over (partition by market order by rank asc nulls last, pair_key)")
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("market", "pair_key", "rank")


def verdict_digest(verdicts: DataFrame, now: str, stale_hours: float) -> DataFrame:
    """Per pair (a, b): the latest verdict (ts, line_no, same, same_event, reason), how many flagged it (an unknown answer does), and mode.

    mode: 'wrong event', 'wrong contract', 'agreed', or 'stale' where nothing was said for ``stale_hours``.
    """
    latest = verdicts.groupBy("a", "b").agg(F.max_by(F.struct("ts", "same", "same_event", "reason"), F.struct("ts", "line_no")).alias("v"), F.count_if(~F.coalesce("same", F.lit(False))).alias("flags"))
    old = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("v.ts").cast("timestamp"))) / 3.6e9 > stale_hours
    mode = F.when(old, "stale").when(F.col("v.same"), "agreed").when(~F.col("v.same_event"), "wrong event").otherwise("wrong contract")
    return latest.select("a", "b", "v.*", "flags", mode.alias("mode"))


def round_robin(rows: DataFrame, category: str, order: str, n: int, offset: int = 0) -> DataFrame:
    """``n`` rows, one of each category in turn, from the ``offset``-th on; inside a category by ``order``."""
    rows = rows.withColumn("turn", F.expr(f"row_number() over (partition by `{category}` order by `{order}`)"))
    return rows.orderBy("turn", category).offset(offset).limit(n).drop("turn")
