"""Writing scans, logs and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.operators.history import dedupe_ranked, latest


def write_scan(pairs: DataFrame, path: str, scan_id: int) -> None:
    """Pairs of one scan, first of each key, books apart; both tables are partitioned by scan and replace that scan only."""
    kept = dedupe_ranked(pairs, "pair_key", "rank").withColumn("scan_id", F.lit(scan_id))
    for rows, name in ((kept.drop("book_a", "book_b"), "pairs"), (kept.select("scan_id", "pair_key", "book_a", "book_b"), "books")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{path}/{name}")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence (venue, market_id, rules_text, source_url, fetched_at) by content: equal text only moves fetched_at."""
    hashed = [d.withColumn("content_hash", F.sha2(F.coalesce("rules_text", F.lit("")), 256)) for d in (old, new)]
    return latest(hashed[0].unionByName(hashed[1]), ["venue", "market_id", "content_hash"], "fetched_at")
