"""Decisions on pairs of contracts, by hand-written pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinbook.operators import decisions

END = "2026-12-31T17:00:00"
#: (contract, contract, match, inverted, reason or None); a contract is a question, or (label, event[, question[, close]]).
CASES = [
    ("Will Brazil beat Argentina?", "Will Argentina beat Brazil?", False, False, "reversed head-to-head"),
    ("Will Brazil beat Argentina?", "Brazil to beat Argentina?", True, False, None),
    ("Anthropic acquired before 2027?", "Will Anthropic IPO before 2027?", False, False, "corporate event"),
    ("Will Mistral AI IPO before 2027?", "Who will IPO before 2027? Mistral AI", True, False, None),
    ("Will Apple leave OPEC in 2026?", "Will Nvidia leave OPEC in 2026?", False, False, "organisation"),
    ("Will a country leave OPEC in 2026?", "Will another country leave OPEC in 2026?", True, False, None),
    ("Will TikTok be banned in the US on Dec 31, 2026?", "TikTok operating legally in the US at end of 2026?", True, True, "opposite states"),
    ("Will Bitcoin dip below $80,000 at any point in 2026?", "BTC to stay above $80k for all of 2026?", True, True, "complementary bounds"),
    (("", "", "Will Bitcoin be above $110,000 on Dec 31, 2026?", END), ("", "", "BTC to touch $110k at any point in 2026?", END), False, False, None),
    (("", "", "Will BTC top $110k in 2026?", END), ("", "", "Will Bitcoin be above $109,999.99 by Dec 31, 2026 at 11:59 PM ET?", END), True, False, None),
    ("Will the Lakers win the 2026 NBA title?", "Will the Celtics win the 2026 NBA title?", False, False, None),
    ("Will the Fed cut rates in March 2026?", "Fed rate hike at March 2026 meeting?", False, False, None),
    ("Will Bitcoin be above $100k in March 2026?", "Will Bitcoin be above $90k in March 2026?", False, False, "threshold"),
    ("Will it close above $5 in 2026?", "Will it close above $5 in 2027?", False, False, "year"),
    (("", "", "Will the NBA MVP be Ann Lee in 2026?", None), ("", "", "Will the NBA MVP be Ann Lee in 2027?", None), True, False, None),
    ("GDP growth between 2.0% to 2.5% in 2026", "GDP growth between 4.6% to 5.0% in 2026", False, False, None),
    ("GDP growth 2.0% to 2.5% in 2026", "GDP growth 2.0 - 2.5% in 2026", True, False, None),
    ("Negative GDP growth in 2026", "GDP growth above 4% in 2026", False, False, None),
    ("Fed emergency rate cut in 2026?", "Fed rate cut in 2026?", False, False, "emergency on one side only"),
    ("Will he be impeached in 2026?", "Will he be impeached and removed in 2026?", False, False, "removal on one side only"),
    (("Bo Nix", "Pro football MVP"), ("Patrick Mahomes", "Pro football MVP"), False, False, "different named outcome"),
    (("Ben Silverman", "Golf open winner"), ("Benjamin Silverman", "Golf open winner"), True, False, None),
    (("Ed Case (D)", "Hawaii House race"), ("Ed Case", "Hawaii House race"), True, False, "equal event and label"),
    ("Julian Ryerson to score first", "Julian Alvarez to score first", False, False, "different person: shared first name"),
    (("Taylor Swift", "Spotify #2 most streamed artist 2025"), ("", "2025 NFL Draft: 1st overall pick", "Will Taylor Swift be the 1st overall pick in the 2025 NFL draft?"), False, False, None),
    (("Texas", "Democrats best tossup Senate race"), ("", "Democratic Senate election winner", "Will Democrats win Texas?"), False, False, None),
    (("Candidate A", "Brazil election first round participants"), ("", "Brazil election second round winner", "Second round participants: Candidate A"), False, False, None),
    (("Renan Santos", "Brazil election first round winner"), ("", "Brazil election 1st round winner", "Will Renan Santos win the first round?"), True, False, None),
    (("Yes", "US recession by end of 2027"), ("", "US recession in 2027", "Will there be a recession in 2027?"), False, False, "deadline vs period"),
    (("Yes", "NBER recession declared by end of 2026"), ("", "NBER recession declared in 2026", "Will NBER declare a recession in 2026?"), True, False, None),
    (("Taylor Swift", "Spotify most streamed artist", None, END), ("Taylor Swift", "NFL draft first pick", None, END), False, False, None),
    (("SELF DRIVE Act", "Which bills become law in 2026?", None, END), ("SELF DRIVE Act", "Which bills become law in 2026?", "A lengthy federal autonomous vehicle bill becomes law before 2027?", END), True, False, "equal event and label"),
    (("Abdul El-Sayed (D)", "Michigan Senate Election Winner"), ("", "Michigan Senate: which counties will Abdul El-Sayed win?", "Will Abdul El-Sayed win Kent County?"), False, False, None),
    ("Senate seats above 68+", "Senate seats above 66+", False, False, None),
    ("Completely other words here", "Nothing of that at all", False, False, "too unlike"),
    ((None, None, None, None), (None, None, None, None), False, False, "too unlike"),
]
SCHEMA = "id long, label string, event string, question string, close string"


def contract(x):
    return (("", "", x, None) if isinstance(x, str) else (*x, *[None] * (4 - len(x))))


def markets(spark, side):
    rows = [(i, *contract(c[side])) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("close", F.to_timestamp("close"))


@pytest.fixture(scope="module")
def decided(spark):
    pairs = spark.range(len(CASES)).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    return {r["id_a"]: r["decision"] for r in decisions.decide_pairs(pairs, markets(spark, 0), markets(spark, 1)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decision(decided, i):
    _, _, match, inverted, reason = CASES[i]
    d = decided[i]
    assert (d["match"], d["inverted"]) == (match, inverted), d
    assert d["reasons"] and (reason is None or reason in d["reasons"]), d
    assert (d["confidence"] > 0) or not match


def test_either_side_first(spark, decided):
    pairs = spark.range(len(CASES)).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    turned = {r["id_a"]: r["decision"] for r in decisions.decide_pairs(pairs, markets(spark, 1), markets(spark, 0)).collect()}
    assert {i: (d["match"], d["inverted"]) for i, d in turned.items()} == {i: (d["match"], d["inverted"]) for i, d in decided.items()}


def test_closes_and_risks(spark):
    rows = [
        (("Ann Lee", "Next Press Secretary?", None, "2026-12-31"), ("Ann Lee", "Next Press Secretary?", None, "2029-01-20"), True, "horizon: venue deadlines differ by more than a year"),
        (("", "Will oil double?", None, "2026-12-31"), ("", "Will anything else happen to prices?", None, "2029-01-20"), False, "horizon: venue deadlines differ by more than a year"),
        (("", "Which NBA team wins?", None, "2026-12-31"), ("", "NBA winner", None, "2029-01-20"), True, "horizon: venue deadlines differ by more than a year"),
        (("", "Will Acme or Bolt list first", None, "2027-01-01"), ("", "Will Acme or Bolt list first?", None, "2040-01-01"), True, "horizon: venue deadlines differ by more than a year"),
        (("", "Highest temperature in Oslo tomorrow", None, None), ("", "Oslo", None, None), True, "weather: venues may settle on different stations"),
        (("", "Will he resign by March 31?", None, None), ("", "Will he resign?", None, None), True, "horizon: only one venue has a deadline"),
        (("", "Will he resign?", None, "2026-01-01"), ("", "Will he resign?", None, "2026-03-01"), True, None),
    ]
    sides = [spark.createDataFrame([(i, *contract(r[k])) for i, r in enumerate(rows)], SCHEMA).withColumn("close", F.to_timestamp("close")) for k in (0, 1)]
    pairs = spark.range(len(rows)).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    got = {r["id_a"]: (r["close_ok"], r["decision"]["risk"]) for r in decisions.decide_pairs(pairs, *sides).collect()}
    assert got == {i: (r[2], r[3]) for i, r in enumerate(rows)}


def test_decisions_keep_all_partitions(spark):
    """Small tables of one partition are read and decided in as many tasks as the session has partitions."""
    rows = lambda n: spark.createDataFrame([(n, None, None, "Will it rain?", None)], "id int, label string, event string, question string, close timestamp").coalesce(1)
    pairs = spark.createDataFrame([(1, 2)], "id_a int, id_b int").coalesce(1)
    found = decisions.decide_pairs(pairs, rows(1), rows(2))
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_contracts_are_broadcast(spark):
    """Tables that look small to Spark still meet by a shuffle: a contract is many times its row."""
    rows = spark.range(1).selectExpr("id", "'' as label", "'' as event", "'Will it rain?' as question", "timestamp '2026-01-01' as close")
    pairs = spark.range(1).selectExpr("id as id_a", "id as id_b")
    plan = decisions.decide_pairs(pairs, rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
