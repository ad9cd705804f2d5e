"""Ingestion that adds up, and log states of hand-written logs."""

from __future__ import annotations

from twinbook.operators import ingest, log_state

MARKET = "market_id string, event_id string, status string, title string, ticker string, event_title string, event_close string, category string"


def test_ingest_adds_up(spark):
    m = lambda i, e, status="active", title="t", ticker="kx", event="e", close="2026-03-01", category="Politics": (i, e, status, title, ticker, event, close, category)
    rows = [
        m("a1", "A"), m("a2", "A", "closed"), m("a3", "A", None), m("b1", "B", close="2025-12-01"), m("c1", "C", category="Sports"), m("d1", "D", close="2027-01-01"), m("e1", "E", close=None), m("e1", "E", close=None),
        m("f1", "F", ticker="MVE-7"), m("g1", "G", title="yes Ann, no Bo"), m("h1", "H", close="2026-02-01", category=None),
    ]
    sweep = [m("a1", "A"), m("z9", "A"), m("o1", "O"), m("o2", "O", "closed"), m("o3", "P", category="Sports")]
    df, extra = spark.createDataFrame(rows, MARKET), spark.createDataFrame(sweep, MARKET)
    snapshots, counts = ingest.ingest(df, "2026-01-01", extra, category="politics", horizon="2026-12-31")
    got = {r["market_id"]: (r["match_excluded"], r["orphan"]) for r in snapshots.collect()}
    assert got == {"a1": (None, False), "e1": (None, False), "f1": ("mve", False), "g1": ("parlay_market", False), "o1": (None, True)}
    c = counts.get
    assert (c["catalog"], c["orphan_scanned"], c["ingested"], c["held_out"]) == (11, 5, 6, 2) and ingest.balanced(c)
    assert {r: c[f"excluded_{r}"] for r in ingest.REASONS} == {"event_closed": 1, "category": 3, "horizon": 1, "event_cap": 0, "orphan_known": 2, "status": 3}
    # Without filters all that is open is there; the cap keeps the events that close first.
    plain, counts = ingest.ingest(df, "2025-01-01")
    assert plain.count() == 9 and ingest.balanced(counts.get) and set(plain.columns) == {*df.columns, "match_excluded"}
    capped, counts = ingest.ingest(df, "2025-01-01", most_events=2)
    assert {r["event_id"] for r in capped.collect()} == {"B", "H"} and counts.get["excluded_event_cap"] == 9
    none, counts = ingest.ingest(df.limit(0), "2025-01-01")
    assert none.count() == 0 and ingest.balanced(counts.get)


def test_log_state(spark):
    good = ["scan done: 400 matched pairs", "AI verify: 5 checked, 4 confirmed, 1 flagged", "EMAILED 3 signals", "[coverage] k: 1,000/1,000 (100.0%) sweep=fresh", "scan done: 420 matched pairs", "scan done: 410 pairs"]
    logs = {
        "good": good, "quiet": ["nothing"] * 3, "low": [*good, "scan done: 90 pairs"], "absent": [*good, "AI verify: key ABSENT"], "dead": [*good, "AI verify: 5 checked, 0 confirmed, 0 flagged"], "unverified": [good[0], good[2]],
        "error": [*good, "CYCLE ERROR: boom"], "old error": ["CYCLE ERROR: boom", *["x"] * 199, *good], "failed": [*good, "EMAIL FAILED: smtp"], "partial": [*good, "[coverage] k: 900/1,000 (90.0%) sweep=partial"], "mended": ["[coverage] k: 900/1,000 (90.0%) sweep=partial", *good],
    }
    lines = spark.createDataFrame([(n, i, t) for n, text in logs.items() for i, t in enumerate(text)], "log string, line_no long, text string")
    got = {r["log"]: r for r in log_state.overall_ok(log_state.log_state(lines)).collect()}
    assert {n for n, r in got.items() if r["ok"]} == {"good", "old error", "mended"}
    g = got["good"]
    assert (g["last_pairs"], g["median_pairs"], g["scans_since_sent"], g["last_sent"], g["recent_error"]) == (410, 410.0, 2, "3 signals", None)
    assert got["quiet"]["last_scan"] is None and got["quiet"]["scans_since_sent"] is None and got["low"]["pairs_low"] and got["absent"]["key_absent"] and got["dead"]["verifier_failing"] and got["unverified"]["sent_unverified"]
    assert got["error"]["recent_error"] == "boom" and got["failed"]["recent_failure"] == "smtp" and got["partial"]["coverage_degraded"] and got["failed"]["last_sent"] == "3 signals"
    assert [(r["log"], r["line_no"]) for r in log_state.tail(lines, 1).where("log in ('good', 'low')").orderBy("log").collect()] == [("good", 5), ("low", 6)]
    assert log_state.log_state(lines.limit(0)).count() == 0
