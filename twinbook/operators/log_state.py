"""The state of a log: what its last marks say, and what came after them.

Lines are (log, line_no, text). The state is a few aggregations with map-side
combining: last marks, then counts of lines behind a mark, which is one row for
each log. No window runs over a whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.functions.snapshots import coverage_degraded, coverage_line

# The marks of a log, the first that a line has counts, and how many lines back an error is recent.
MARKS = (("scan", "scan done"), ("failed", "EMAIL FAILED"), ("sent", "EMAILED"), ("verified", "AI verify:"), ("error", "CYCLE ERROR"))
RECENT, LEAST_SCANS, USUAL, LOW = 200, 3, 100, 0.5


def marked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``mark``, ``said`` (what stands behind the mark), ``pairs`` of a scan and ``coverage``."""
    mark = F.coalesce(*(F.when(F.contains("text", F.lit(t)), F.lit(n)) for n, t in MARKS))
    said = F.coalesce(*(F.when(F.col("mark") == n, F.trim(F.regexp_extract("text", rf"{t}:?(.*)$", 1))) for n, t in MARKS))
    pairs = F.when(F.col("mark") == "scan", F.regexp_extract("text", r"(\d+)\s+(?:matched\s+)?pairs", 1).try_cast("long"))
    return lines.withColumn("mark", mark).withColumns({"said": said, "pairs": pairs, "coverage": coverage_line(F.col("text"))})


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each log, whose numbers have no gaps."""
    last = lines.groupBy("log").agg(F.max("line_no").alias("last"))
    return lines.join(last, "log").where(F.col("line_no") > F.col("last") - n).drop("last")


def log_state(lines: DataFrame) -> DataFrame:
    """Per log: last_scan, last_pairs, median_pairs, pairs_low, last_sent, scans_since_sent, last_verified, key_absent, verifier_failing, sent_unverified, recent_error, recent_failure, coverage_degraded.

    ``pairs_low``: the last scan found less than half of the median of at least
    three scans. Errors and failed sendings are recent within RECENT lines of the
    log's end. The last coverage line of each venue counts.
    """
    rows = marked(lines)
    at = lambda name: F.when(F.col("mark") == name, F.col("line_no"))
    last = rows.groupBy("log").agg(
        F.max("line_no").alias("end"), F.max(at("sent")).alias("sent_at"), F.max(at("error")).alias("error_at"), F.max(at("failed")).alias("failed_at"), F.count("pairs").alias("n_scans"),
        *(F.max_by("said", at(n)).alias(n) for n, _ in MARKS), F.max_by("pairs", F.when(F.col("pairs").isNotNull(), F.col("line_no"))).alias("last_pairs"), F.median("pairs").alias("median_pairs"),
    )
    behind = rows.where("mark = 'scan'").join(last.select("log", "sent_at"), "log").where(F.col("line_no") > F.col("sent_at")).groupBy("log").agg(F.count("*").alias("since"))
    venues = rows.where("coverage is not null").groupBy("log", "coverage.venue").agg(F.max_by("coverage", "line_no").alias("coverage"))
    degraded = venues.groupBy("log").agg(F.bool_or(coverage_degraded(F.col("coverage"))).alias("degraded"))
    out = last.join(behind, "log", "left").join(degraded, "log", "left")
    checked = [F.regexp_extract("verified", r"(\d+) checked, (\d+) confirmed, (\d+) flagged", i).try_cast("long") for i in (1, 2, 3)]
    absent = F.coalesce(F.contains("verified", F.lit("ABSENT")), F.lit(False))
    recent = lambda name: F.when(F.col(f"{name}_at") > F.col("end") - RECENT, F.col(name))
    return out.select(
        "log", F.col("scan").alias("last_scan"), "last_pairs", "median_pairs",
        F.coalesce((F.col("n_scans") >= LEAST_SCANS) & (F.col("median_pairs") >= USUAL) & (F.col("last_pairs") < LOW * F.col("median_pairs")), F.lit(False)).alias("pairs_low"),
        F.col("sent").alias("last_sent"), F.when(F.col("sent_at").isNotNull(), F.coalesce("since", F.lit(0))).alias("scans_since_sent"), F.col("verified").alias("last_verified"), absent.alias("key_absent"),
        F.coalesce(~absent & (checked[0] > 0) & (checked[1] + checked[2] == 0), F.lit(False)).alias("verifier_failing"), (F.col("sent").isNotNull() & F.col("verified").isNull()).alias("sent_unverified"),
        recent("error").alias("recent_error"), recent("failed").alias("recent_failure"), F.coalesce("degraded", F.lit(False)).alias("coverage_degraded"),
    )


def overall_ok(state: DataFrame) -> DataFrame:
    """``state`` with ``ok``: a scan was seen, and nothing of what the state watches for holds."""
    bad = F.col("key_absent") | F.col("verifier_failing") | F.col("sent_unverified") | F.col("pairs_low") | F.col("coverage_degraded") | F.col("recent_error").isNotNull() | F.col("recent_failure").isNotNull()
    return state.withColumn("ok", F.col("last_scan").isNotNull() & ~bad)
