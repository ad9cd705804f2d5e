"""Operators against plain Python on random and edge cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinbook.functions import dates, features, pricing, text
from twinbook.operators import assignment, group_match, history, ladders, price_ladders, similarity, vetoes
from twinbook.streaming.alerts import alert_stream


def sequential_fill(a, b, budget=None):
    """Level by level, as a person would buy."""
    a, b = [list(x) for x in sorted(a)], [list(x) for x in sorted(b)]
    n = cost_a = cost_b = 0.0
    while a and b:
        pa, pb = a[0][0], b[0][0]
        if 1 - pa - pb - round(0.07 * pb * (1 - pb), 4) <= 1e-12:
            break
        want = min(a[0][1], b[0][1])
        q = want if budget is None else max(0.0, min(want, (budget - cost_a) / pa, (budget - cost_b) / pb))
        n, cost_a, cost_b = n + q, cost_a + q * pa, cost_b + q * pb
        if q < want:
            break
        for leg in (a, b):
            leg[0][1] -= q
            if leg[0][1] <= 1e-12:
                leg.pop(0)
    return n, cost_a, cost_b


@pytest.mark.parametrize("budget", [None, 12.0])
def test_lockstep_fill(spark, budget):
    rng = random.Random(5)
    books = {i: [[(rng.randint(10, 60) / 100, float(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))] for _ in "ab"] for i in range(60)}
    legs = [
        spark.createDataFrame([(i, p, s, k) for i, book in books.items() for k, (p, s) in enumerate(book[side])], "pair int, price double, size double, pos int")
        for side in (0, 1)
    ]
    got = {r["pair"]: (r["contracts"], r["cost_a"], r["cost_b"]) for r in ladders.lockstep_fill(*legs, budget=budget).collect()}
    for i, (a, b) in books.items():
        want = sequential_fill(a, b, budget)
        if want[0] > 1e-9:
            assert got[i] == pytest.approx(want)
        else:
            assert i not in got or got[i][0] == pytest.approx(0)


def test_greedy_assignment(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(0, 5) / 5) for _ in range(200)]
    best = {}
    for a, b, s in edges:
        best[a, b] = max(s, best.get((a, b), -1))
    used_a, used_b, want = set(), set(), set()
    for (a, b), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if a not in used_a and b not in used_b:
            want.add((a, b, s))
            used_a.add(a)
            used_b.add(b)
    got = assignment.greedy_assign(spark.createDataFrame(edges, "a int, b int, score double"))
    assert {tuple(r) for r in got.collect()} == want
    assert assignment.greedy_assign(spark.createDataFrame([], "a int, b int, score double")).count() == 0


def test_greedy_assignment_of_copies_needs_few_steps(spark, monkeypatch):
    """Copies that tie, near copies that all like the same best, chains and many small components: as one edge after the other, in steps that don't grow with a group."""
    cuts = []
    monkeypatch.setattr(assignment, "cut", lambda df, cut=assignment.cut: cuts.append(1) or cut(df))
    rng = random.Random(5)
    edges = [(f"a{i:03}", f"b{j:03}", 1.0) for i in range(40) for j in range(30)]
    edges += [(f"c{i:03}", f"d{j:03}", 2.0 - (i + j) / 100) for i in range(30) for j in range(30)]
    edges += [(f"e{i:03}", f"f{i + k:03}", 0.5 + i / 1000) for i in range(90) for k in (0, 1)]
    edges += [(f"g{rng.randrange(99)}", f"h{rng.randrange(99)}", rng.randrange(4) / 4) for _ in range(150)] + [("a001", "d001", 0.3), ("e001", "b001", 0.2)]
    want, used = [], set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {("a", a), ("b", b)} & used:
            want.append((a, b, s))
            used |= {("a", a), ("b", b)}
    got = assignment.greedy_assign(spark.createDataFrame(edges, "a string, b string, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(cuts) < 35


@pytest.mark.parametrize("threshold", [0.15, 0.45, 1.0])
def test_similarity_join_loses_no_pair(spark, threshold):
    rng = random.Random(9)
    sets = {i: sorted({*rng.sample("abcdefghijkl", rng.randint(0, 6)), *(["x"] if rng.random() < 0.6 else [])}) for i in range(80)}
    sides = [spark.createDataFrame([(i, t) for i, t in sets.items() if i % 2 == k], "id int, toks array<string>") for k in (0, 1)]
    got = {(r["id_a"], r["id_b"]) for r in similarity.similarity_join(*sides, threshold).collect()}
    want = {
        (i, j) for i in sets for j in sets
        if i % 2 == 0 and j % 2 == 1 and set(sets[i]) | set(sets[j]) and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= threshold
    }
    assert got == want


def test_similarity_join_meets_blocks_without_shuffling_candidates(spark, monkeypatch):
    """Several blocks a side, large groups of copies, parts cut small: brute force agrees, and only whole sets are shuffled."""
    from twinbook.operators import set_blocks

    for name, value in (("BLOCK", 300), ("CELLS", 64), ("SHARED", 256), ("SENT", 50)):
        monkeypatch.setattr(set_blocks, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    sets = {i: sorted(rng.sample(words[:12] if i % 3 else words, rng.randint(1, 9))) for i in range(300)}
    sets |= {i: ["copied", "words"] for i in range(300, 360)}
    sides = [spark.createDataFrame([(f"d{i}", t) for i, t in sets.items() if i % 2 == k], "id string, toks array<string>") for k in (0, 1)]
    found = similarity.similarity_join(*sides, 0.45)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in found.collect()}
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    assert got == {(f"d{i}", f"d{j}"): alike(i, j) for i in sets for j in sets if i % 2 == 0 and j % 2 == 1 and alike(i, j) >= 0.45}


def test_similarity_join_meets_blocks_of_like_sizes(spark, monkeypatch):
    """Blocks hold neighbouring sizes, one to a partition, and those too far apart in size are not met; no pair is lost."""
    from twinbook.operators import set_blocks

    monkeypatch.setattr(set_blocks, "BLOCK", 400)
    rng = random.Random(6)
    sets = {i: sorted(rng.sample(range(70), 1 + i % 60)) for i in range(240)}
    rows = spark.createDataFrame([(i % 2, i, t) for i, t in sets.items()], "side int, id int, keys array<bigint>")
    parts = [sorted(len(r["keys"]) for r in p) for p in set_blocks._dealt(rows).rdd.glom().collect()]
    parts = sorted((p[0], p[-1]) for p in parts if p)
    assert len(parts) > 5 and all(x[1] <= y[0] for x, y in zip(parts, parts[1:], strict=False))
    sides = [rows.where(f"side = {k}").selectExpr("id", "transform(keys, k -> cast(k as string)) as toks") for k in (0, 1)]
    found = similarity.similarity_join(*sides, 0.45)
    assert "least_a" in found._jdf.queryExecution().executedPlan().toString()
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    assert {(r["id_a"], r["id_b"]) for r in found.collect()} == {(i, j) for i in range(0, 240, 2) for j in range(1, 240, 2) if alike(i, j) >= 0.45}


def test_interval_join(spark):
    at = datetime(2026, 1, 1)
    rows = [("k", i, at + timedelta(minutes=47 * i)) for i in range(20)]
    a = spark.createDataFrame(rows, "key string, i int, t_a timestamp")
    b = spark.createDataFrame(rows, "key string, j int, t_b timestamp")
    got = {(r["i"], r["j"]) for r in similarity.within(a, b, 2.0).collect()}
    assert got == {(i, j) for i in range(20) for j in range(20) if abs(i - j) * 47 <= 120}


def test_books_and_nulls(spark):
    df = spark.createDataFrame([([["0.4", "10"], ["0.6", "1"], ["x", "1"], ["0", "5"], ["0.5", "0"]],), ([],), (None,)], "raw array<array<string>>")
    rows = df.select(F.transform(pricing.parse_side(F.col("raw"), True), lambda x: x["price"]).alias("p")).collect()
    assert [r["p"] for r in rows] == [[0.6, 0.4], [], None]
    jac = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in jac.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]
    legs = spark.createDataFrame([("r", 0.1), ("r", None), ("s", 0.2)], "race string, ask double")
    assert {r["race"]: r["ask"] for r in price_ladders.basket_price(legs, ["race"]).collect()} == {"r": None, "s": 0.2}


def test_times(spark):
    df = spark.createDataFrame([("2026-09-26T17:00:00Z",), ("2026-09-26 17:00:00+00",), ("2026-09-26",), ("junk",), (None,)], "t string")
    assert [r[0] and r[0].hour for r in df.select(dates.parse_time(F.col("t"))).collect()] == [17, 17, 0, None, None]
    ticker = spark.createDataFrame([("26SEP21", "2015")], "d string, c string")
    assert ticker.select(dates.ticker_time(F.col("d"), F.col("c"))).first()[0] == datetime(2026, 9, 22, 0, 15)


def test_vetoes_end_words_as_sql_does(spark):
    """Letters beyond ASCII end a word, as they do in the SQL."""
    rows = [("año nuevo", "x"), ("éfirst", "x"), ("WİTHOUT", "x"), ("annotation", "x"), ("2024é", "2025")]
    df = vetoes.with_features(spark.createDataFrame(rows, "ta string, tb string"), "ta").withColumnRenamed("spec", "spec_a")
    got = vetoes.judge(vetoes.with_features(df, "tb").withColumnRenamed("spec", "spec_b")).select("ta", "reasons", "inverted").collect()
    want = {"año nuevo": ([], False), "éfirst": (["first"], False), "WİTHOUT": ([], True), "annotation": ([], False), "2024é": (["year", "number"], False)}
    assert {r["ta"]: (r["reasons"], r["inverted"]) for r in got} == want


def test_features_of_batches_are_those_of_columns(spark):
    """All features read from Arrow batches, none by patterns of the JVM, equal the single columns."""
    texts = [None, "", "Will São Paulo win the 2nd Grand Prix by 3.5+ points in Q3 2026, May 5?", "A vs. B: o/u 45.5, 1st half (-3.5)", "Fed cuts 25 bps in March; Best Picture or MVP at the 2026 Oscars?", "Senate control, TX-12 seat, above $5k or below 3%"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, title string").withColumn("low", features.ascii_lower(F.col("title")))
    plan = rows.select(features.spec(F.col("title"), F.col("low")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "regexp_extract" not in plan
    table = {n: f for family in features.FAMILIES.values() for n, f in family.items()}
    got = rows.select("id", features.spec(F.col("title"), F.col("low")).alias("s")).orderBy("id").collect()
    want = rows.select("id", F.struct(*(features.column(f, F.col("title"), F.col("low")).alias(n) for n, f in table.items())).alias("s")).orderBy("id").collect()
    for g, w in zip(got, want, strict=True):
        assert g["s"].asDict() == w["s"].asDict()


def test_games_meet_in_buckets_of_time(spark):
    """Games of one key meet by time, not all with all; starts known on one side fall back to days."""
    at = lambda day, hour: datetime(2026, 1, day, hour)
    rows = [(0, "L", at(1, 5)), (1, "M", at(1, 8)), (2, "L", at(3, 23)), (3, "M", at(4, 3)), (4, "L", None), (5, "M", at(9, 1)), (6, "L", at(20, 0)), (7, "M", at(20, 0)), (9, "M", at(20, 0))]
    days = {4: at(8, 0)}
    games = spark.createDataFrame([(g, league, ["x", "y"], t, (t or days[g]).date()) for g, league, t in rows], "game int, league string, teams array<string>, start timestamp, day date")
    found = group_match.match_games(games.where("game % 2 = 0"), games.where("game % 2 = 1"))
    assert "bucket" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1, "L", "M"), (4, 5, "L", "M")]


def test_vetoes(spark):
    rows = [("Rate above 5 in March 2026", "Rate below 5 in March 2026"), ("Will X win by 2026", "Will X not win by 2026"), ("Final in 2025", "Final in 2026"), (None, "Final in 2026")]
    df = spark.createDataFrame(rows, "ta string, tb string")
    df = vetoes.with_features(df, "ta").withColumnRenamed("spec", "spec_a")
    df = vetoes.with_features(df, "tb").withColumnRenamed("spec", "spec_b")
    got = [(r["reasons"], r["inverted"]) for r in vetoes.judge(df).select("reasons", "inverted").collect()]
    assert got == [(["direction"], False), ([], True), (["year", "number"], False), ([], False)]


def test_scan_history(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None)], "key int, net double")
    b = spark.createDataFrame([(2, 0.25), (3, 0.1), (4, 0.4)], "key int, net double")
    assert {(r["key"], r["change"]) for r in history.compare_scans(a, b).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}


@pytest.fixture
def one_partition(spark):
    """State in one partition, for streams of a few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_alert_stream(spark, tmp_path, one_partition):
    """Every row of a stream that is stopped and started again after each batch; one delivery fails and is repeated."""
    from twinbook.streaming.alerts import deliver

    at = datetime(2026, 1, 1)
    batches = [
        [("p", 0.05, at), ("q", 0.02, at)],
        [("p", 0.051, at + timedelta(hours=1)), ("q", 0.03, at + timedelta(hours=1))],
        [("p", 0.05, at + timedelta(hours=30)), (None, 0.1, at)],
        [("r", 0.01, at + timedelta(days=15)), ("r", 0.015, at + timedelta(days=15, hours=2))],
        [("s", 0.01, at + timedelta(days=16))],
        [("p", 0.04, at + timedelta(days=20)), ("q", 0.03, at + timedelta(days=20))],
    ]
    schema, sent, failing = "key string, net double, ts timestamp", [], [3]

    def send(rows, number):
        got = [(r["key"], (r["ts"] - at) / timedelta(hours=1), r["reason"]) for r in rows.collect()]
        if failing and got and any(x[0] == "r" for x in got):
            failing.pop()
            raise OSError("not delivered")
        sent.extend(got)

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            query = deliver(alert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), send, f"{tmp_path}/cp")
            try:
                query.awaitTermination(180)
                break
            except Exception as failed:  # noqa: BLE001
                assert "not delivered" in str(failed)
    assert not failing
    # p and q were forgotten after a week, and so are new again.
    assert sorted(sent) == [("p", 0, "new"), ("p", 30, "due"), ("p", 480, "new"), ("q", 0, "new"), ("q", 1, "improved"), ("q", 480, "new"), ("r", 360, "new"), ("r", 362, "improved"), ("s", 384, "new")]


def test_degradation_alerts(spark, tmp_path, one_partition):
    from twinbook.streaming.alerts import degradation_alerts

    at, schema = datetime(2026, 1, 1), "key string, ts timestamp, reason string"
    for i, rows in enumerate([[("a", at, "boom\n  here"), ("a", at + timedelta(minutes=1), "again"), (None, at, "x")], [("a", at + timedelta(minutes=59), "again"), ("b", at, None), ("a", at + timedelta(minutes=61), "later")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = degradation_alerts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(180)
    assert sorted((r["key"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "boom here"), ("a", "later"), ("b", "")]


def test_signals_to_send(spark):
    from twinbook.streaming.alerts import signals_to_send

    at = datetime(2026, 1, 1)
    signals = spark.createDataFrame([("new", 0.02, 9.0), ("same", 0.03, 8.0), ("up", 0.05, 7.0), ("old", 0.03, 6.0), ("poor", 0.0, 99.0), ("late", 0.9, None)], "key string, net double, annualised double")
    state = spark.createDataFrame([("same", 0.03, at), ("up", 0.04, at), ("old", 0.03, at - timedelta(hours=30)), ("gone", 0.1, at)], "key string, net double, ts timestamp")
    send = lambda rows, **k: {r["key"]: r["label"] for r in signals_to_send(rows, state, F.lit(at), 24.0, **k).collect()}
    assert send(signals) == {"new": "new", "same": None, "up": "improved", "old": "due", "late": "new"}
    assert send(signals, top=2) == {"new": "new", "same": None}
    assert send(signals.where("key = 'same'")) == {} and send(signals.limit(0)) == {} and len(send(signals, top=0)) == 5


def test_match_groups_keeps_first_losses(spark):
    from twinbook.operators.group_match import match_groups

    events = "id string, toks array<string>"
    outcomes = "event string, id int, toks array<string>, mid double"
    a = spark.createDataFrame([("A", 1, ["x", "y"], 0.5), ("A", 2, ["x", "z"], None)], outcomes)
    b = spark.createDataFrame([("B", 7, ["x", "y"], 0.5), ("B", 8, ["q"], 0.1)], outcomes)
    got = match_groups(spark.createDataFrame([("A", ["e"])], events), spark.createDataFrame([("B", ["e"])], events), a, b, 0.5).collect()
    assert [(r["id_a"], r["id_b"], round(r["score"], 6)) for r in got] == [(1, 7, 1.0)]


def test_search_arguments(spark):
    from twinbook.operators.query_tools import Search, search_pairs

    rows = [(i, f"t{i}", "c", i / 10 if i else None, 1.0, 2, i, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, title string, category string, net double, profit double, contracts int, days int, flagged boolean")
    got = search_pairs(df, Search(text="T1", flagged=True, limit=500)).collect()
    assert [r["key"] for r in got] == [18, 16, 14, 12, 10] and {r["total_candidates"] for r in got} == {11}
    assert search_pairs(df, Search(limit=500)).count() == 50
    with pytest.raises(ValueError):
        Search(sort="nothing")


def test_rule_flags(spark):
    rows = [
        ("In the event of a tie it resolves to No. Other text.", "A tie is split evenly. More."), ("Most votes win.", "Most votes win."), ("Most votes or most seats.", "Most seats."),
        (None, "Most seats."), ("", "Most seats."), ("Signed into law " + "x" * 300 + " by May.", "On the announcement."), ("Exactly 3.\nAt least 4", "At least 5 points."),
    ]
    got = spark.createDataFrame(rows, "a string, b string").select(vetoes.rule_flags(F.col("a"), F.col("b")).alias("f")).collect()
    kinds = [[(f["kind"], f["policy_a"], f["policy_b"]) for f in r["f"]] for r in got]
    assert kinds == [[("tie_break", "none", "split")], [], [], [], [], [("event_definition", "signed", "announced")], []]
    assert got[0]["f"][0]["excerpt_a"] == "In the event of a tie it resolves to No." and got[0]["f"][0]["excerpt_b"] == "A tie is split evenly."
    assert len(got[5]["f"][0]["excerpt_a"]) == 200 and got[5]["f"][0]["excerpt_a"].endswith("…")


def test_title_features(spark):
    from twinbook.functions import features

    cases = [
        ("numbers", "bps", "Fed cuts 25 bps or 50 basis points", ["25", "50"]), ("numbers", "bps_bucket", "Will the Fed cut rates by 25 bps?", ["cut", "25", ""]),
        ("times", "months", "by MAY or June", ["june", "may"]), ("times", "fiscal", "Q3 2025 earnings", ["q3 2025"]), ("scopes", "districts", "TX-15 seat", ["tx-15"]),
        ("scopes", "judicial", "Will X be confirmed to the Supreme Court", "seated"), ("scopes", "judicial", "Will X be confirmed", None), ("scopes", "states", "west virginia or Indiana", ["indiana", "virginia", "west virginia"]),
        ("scopes", "brazil", "Governor of São Paulo", ["sao paulo"]), ("scopes", "brazil", "Mayor of São Paulo", []), ("sports", "matchup", "Nice at Lyon", ["nice", "lyon"]), ("sports", "ranks", "#1 or top 5, 3rd", ["1", "3", "5"]),
        ("sports", "periods", "1st half of the match", ["h1"]), ("sports", "award_phrases", "Best Picture", ["best picture"]), ("names", "proper", "Will Ann Lee beat Bo Fox", ["Bo Fox", "Will Ann Lee"]), ("names", "is_name", "Ann Lee", True),
        ("sports", "womens", None, False), ("numbers", "rates", "", []),
    ]
    cases = [(f, n, t, w if n != "states" else ["indiana", "virginia"]) for f, n, t, w in cases]
    for family, name, title, want in cases:
        got = spark.range(1).select(features.column(features.FAMILIES[family][name], F.lit(title).cast("string"))).first()[0]
        assert got == want, (name, title, got)
    bounds = {
        "BTC above $150k?": (True, 150000.0, "usd"), "more than 10 wins": (True, 11.0, "count"), "at least 10 wins": (True, 10.0, "count"), "under 3.5% inflation": (False, 3.5, "pct"), "between 3 and 5": None, "above 3-5": None, "fewer than 4": (False, 3.0, "count"),
        "over $1,250 million": (True, 1.25e9, "usd"), None: None,
    }
    rows = spark.createDataFrame([(k,) for k in bounds], "t string").select(features.threshold(F.col("t")).alias("b")).collect()
    assert [None if r["b"] is None else tuple(r["b"]) for r in rows] == list(bounds.values())
    names = spark.sql("select 'Jon Smith' as a, 'Jonathan Smith' as b, 'Ann Lee' as c")
    assert names.select(features.same_person(F.col("a"), F.col("b")), features.different_names(F.col("a"), F.col("b")), features.different_names(F.col("a"), F.col("c"))).first() == (True, False, True)
    assert spark.sql("select 'São (new) Paulo!' as a").select(features.label_key(F.col("a")), features.same_label(F.col("a"), F.lit("sao paulo"))).first() == ("saopaulo", True)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Will the Senate race in Ohio", "Will the governor race in Ohio", "office"), ("Winner 2025", "Winner 2026", "year"), ("Fed cuts 25 bps", "Fed cuts 50 bps", "rate move"), ("Lakers qualify", "Lakers relegated", "advance or fall"),
        ("Best Picture", "Best Director", "award"), ("Oscars host", "Emmys host", "ceremony"), ("WNBA champion", "NBA champion", "league"), ("1st half", "2nd half", "match period"), ("Team undefeated", "Team winless", "season outcome"),
        ("Anything at all", "Anything at all", None), ("X", None, None),
    ],
)
def test_title_conflicts(spark, a, b, want):
    from twinbook.operators import conflicts

    rows = conflicts.with_spec(spark.createDataFrame([(0, a), (1, b)], "i int, title string"))
    pair = rows.where("i = 0").select(F.col("spec").alias("spec_a")).crossJoin(rows.where("i = 1").select(F.col("spec").alias("spec_b")))
    got = conflicts.conflicts(pair).first()
    assert got["reason"] == want or want in got["reasons"]


def test_match_markets(spark):
    from twinbook.operators import market_match

    left = [(1, "Will Ann Lee win the Ohio governor race?", "2025-01-01"), (2, "Bitcoin above $100k", None), (3, "Fed cuts 25 bps in March", "2025-03-20"), (4, "Totally other words", None), (5, "Will Bo Fox win the Iowa Senate race?", None)]
    right = [(11, "Ann Lee to win the Ohio governor race", "2025-01-03"), (12, "BTC Bitcoin price above $100,000", None), (13, "Fed cuts 50 bps in March", "2025-03-20"), (14, "Nothing alike", None), (15, "Will Bo Fox win the Iowa governor race?", None)]
    make = lambda rows: spark.createDataFrame(rows, "id long, title string, close string").withColumn("close", F.to_timestamp("close"))
    forced = spark.createDataFrame([(4, 14), (99, 1)], "id_a long, id_b long")
    got = {(r["id_a"], r["id_b"]): (round(r["similarity"], 4), r["via_override"]) for r in market_match.match_markets(make(left), make(right), overrides=forced).collect()}
    assert got == {(1, 11): (round(7 / 9, 4), False), (2, 12): (round(2 / 7, 4), False), (4, 14): (0.0, True)}


def test_match_inverted_markets(spark):
    from twinbook.operators import market_match

    left = [(1, "Will Bitcoin dip below $80,000 at any point in 2026?"), (2, "Will TikTok be banned in the US in 2026?"), (3, "Will the merger close in 2026?")]
    right = [(11, "Bitcoin to stay above $80,000 at any time in 2026?"), (12, "TikTok operating legally in the US in 2026?"), (13, "Will the merger close in 2026?")]
    make = lambda rows: spark.createDataFrame(rows, "id long, title string").withColumn("close", F.lit(None).cast("timestamp"))
    got = {(r["id_a"], r["id_b"]): r["inverted"] for r in market_match.match_markets(make(left), make(right), least=0.3).collect()}
    assert got == {(1, 11): True, (2, 12): True, (3, 13): False}
    quotes = spark.createDataFrame([(0.3, 0.4, True), (0.3, 0.4, False), (None, 0.4, True)], "bid_b double, ask_b double, inverted boolean")
    assert [(r["bid_b"], r["ask_b"]) for r in market_match.oriented(quotes).collect()] == [(0.6, 0.7), (0.3, 0.4), (0.6, None)]


def test_rung_labels(spark):
    from twinbook.functions import rungs as g

    inf = float("inf")
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    read = lambda label: (x := one(g.bucket(F.lit(label)))) and tuple(x)
    assert [read(x) for x in ("Republican 25-30%", "R 30%+", "Lula da Silva <5%", "Democratic Wins", "GOP 2.5–5", "nothing", "10-15%", None)] == [
        ("republican", 25.0, 30.0), ("r", 30.0, inf), ("lula da silva", 0.0, 5.0), ("democrat", 0.0, inf), ("republican", 2.5, 5.0), None, ("", 0.0, 15.0), None,
    ]
    held = lambda label, floor: (x := one(g.rung(F.lit(label), F.lit(floor).cast("double")))) and tuple(x)
    assert [held(*x) for x in (("Republicans, 26+ pts", None), ("Hageman, 26+ pts", 25.5), ("Hageman 26", None))] == [("republican", 26.0), ("hageman", 25.5), None]
    assert one(g.race_key(F.lit("Wyoming Senate margin of victory"))) == one(g.race_key(F.lit("The 2026 Wyoming Senate Election Margin of Victory"))) == "wyoming senate"


def test_ladder_synthesis(spark):
    inf = float("inf")
    rungs = [(r, "x", float(t), f"{r}{t}", "t", 0.9, 0.95) for r, t in (("e", 10), ("e", 7), ("gap", 5), ("cap", 10), ("wins", 5), ("unq", 7), ("none", 1), ("span", 10))] + [("e", "y", 10.0, "ey", "t", None, 0.32)]
    buckets = [("e", "x", 0.0, 5.0, "b1", 0.1, 0.1), ("e", "x", 5.0, 10.0, "b2", 0.15, 0.15), ("e", "x", 10.0, inf, "b3", 0.2, 0.26), ("e", "y", 10.0, inf, "b4", 0.4, 0.4)]
    buckets += [("gap", "x", 5.0, 10.0, "g1", 0.1, 0.1), ("gap", "x", 15.0, inf, "g2", 0.1, 0.1), ("cap", "x", 10.0, 15.0, "c1", 0.2, 0.2), ("wins", "x", 0.0, inf, "w1", 0.55, 0.6)]
    buckets += [("unq", "x", 5.0, 10.0, "u1", 0.1, None), ("unq", "x", 10.0, inf, "u2", 0.2, 0.2), ("span", "x", 9.0, 12.0, "s1", 0.2, 0.2), ("span", "x", 12.0, inf, "s2", 0.3, 0.3)]
    found = price_ladders.synthesize(
        spark.createDataFrame(rungs, "race string, side string, threshold double, id string, title string, bid double, ask double"),
        spark.createDataFrame([(*b[:5], f"label {b[4]}", *b[5:]) for b in buckets], "race string, side string, lo double, hi double, id string, label string, bid double, ask double"),
    )
    got = {r["id"]: (r["exact"], r["sub_bid"], r["sup_ask"], r["sub_legs"], r["sup_legs"]) for r in found.collect()}
    assert got == {
        "e10": (True, 0.2, 0.26, ["b3"], ["b3"]), "e7": (False, 0.2, 0.41, ["b3"], ["b2", "b3"]), "gap5": (True, 0.2, None, ["g1", "g2"], ["g1", "g2"]), "cap10": (True, 0.2, None, ["c1"], ["c1"]),
        "wins5": (False, None, 0.6, [], ["w1"]), "unq7": (False, 0.2, None, ["u2"], ["u1", "u2"]), "span10": (False, 0.3, 0.5, ["s2"], ["s1", "s2"]), "ey": (True, 0.4, 0.4, ["b4"], ["b4"]),
    }
    fees = {r["id"]: (r["direction"], r["edge"], r["legs"]) for r in price_ladders.edges(found).collect()}
    assert fees["span10"] == ("sell rung", 0.3937, ["s1", "s2"]) and fees["ey"] == ("buy rung", round(0.4 - 0.32 - 0.07 * 0.32 * 0.68, 4), ["b4"]) and fees["cap10"][0] == "buy rung"
    free = {r["id"]: r["edge"] for r in price_ladders.edges(found, fee=0.0).collect()}
    assert free["e7"] == 0.49 and len(free) == 8


def test_reviews(spark):
    from twinbook.operators import reviews

    ev = spark.createDataFrame([("a", 1, "x", "2024-01-01", "Most votes."), ("a", 1, "y", "2024-01-02", "Most votes."), ("b", 2, "z", "2024-01-01", "Most seats.")], "venue string, market_id int, content_hash string, fetched_at string, rules_text string")
    rv = spark.createDataFrame([(1, 1, 2, "x", "z"), (2, 1, 2, "y", None), (3, 5, 2, "x", "z"), (4, 1, 2, "y", "old")], "id int, market_a int, market_b int, hash_a string, hash_b string")
    assert {r["id"]: r["stale"] for r in reviews.with_staleness(rv, ev).collect()} == {1: True, 2: False, 3: False, 4: True}
    flags = {r["id"]: r["rule_flags"] for r in reviews.with_rule_flags(rv, ev).collect()}
    assert flags[3] is None and [f["kind"] for f in flags[1]] == ["ranking_basis"]
    scans = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "failed")], "id int, status string")
    pairs = spark.createDataFrame([(1, "k", 7, 1), (2, "k", 7, None), (2, "l", 7, 0), (3, "k", 7, 0)], "scan_id int, pair_key string, market_a int, rank int")
    assert {tuple(r) for r in reviews.newest_scan_with(pairs, scans).collect()} == {("k", 2), ("l", 2)}
    assert [tuple(r) for r in reviews.market_pairs(pairs, scans, "a", 1).collect()] == [(7, "l", 0)]
    assert {r["scan_id"]: r["b"] for r in reviews.pairs_with_books(pairs.where("pair_key = 'k'"), spark.createDataFrame([(1, "k", "book")], "scan_id int, pair_key string, b string")).collect()} == {1: "book", 2: None, 3: None}
    eco = spark.createDataFrame([(10.0, 5.0, 0.1), (0.0, 5.0, 0.1), (10.0, None, 0.1)], "contracts double, profit double, roi double")
    assert [r["capital"] for r in reviews.depth_economics(eco).collect()] == [50.0, None, None]


def test_first_of_keeps_the_first(spark):
    from twinbook.sources.tables import first_of

    rows = spark.createDataFrame([("a", None, 3), ("a", None, 1), ("", "b", 2), (None, "b", 5)], "x string, y string, at int")
    assert {r["at"] for r in first_of(rows, "x", "y", order="at").collect()} == {1, 2}


def test_snapshot_functions(spark):
    from twinbook.functions import snapshots as s

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    levels = lambda *rows: F.array(*(F.array(F.lit(p), F.lit(q)) for p, q in rows))
    book = one(s.full_book(levels(("0.40", "5"), ("0.42", "3"), ("1.2", "1")), levels(("0.50", "7"), ("0.55", "2"))))
    assert [tuple(x) for x in book["bids"]] == [(0.42, 3.0), (0.40, 5.0)] and [tuple(x) for x in book["asks"]] == [(0.45, 2.0), (0.5, 7.0)]
    inline = one(s.inline_book(F.lit(0.4), F.lit(None).cast("double"), F.lit(1.0), F.lit(3.0)))
    assert [tuple(x) for x in inline["bids"]] == [(0.4, 0.0)] and inline["asks"] == []
    assert tuple(one(s.coverage_line(F.lit("x [coverage] kx: 1,234/1,300 (94.9%) sweep=partial [PARTIAL CATALOG]")))) == ("kx", 1234, 1300, 94.9, "partial", True)
    assert one(s.coverage_line(F.lit("nothing"))) is None and one(s.coverage_line(F.lit("[coverage] pm: 5/0 (n/a) sweep=off")))["pct"] is None
    assert one(s.coverage_degraded(s.coverage_line(F.lit("[coverage] pm: 5/5 (100.0%) sweep=off")))) is False
    labels, tokens = F.array(F.lit("Yes"), F.lit("No")), F.array(F.lit("t1"), F.lit("t2"))
    assert [one(s.token_for(F.lit(x), labels, tokens)) for x in ("no", "YES")] == ["t2", "t1"]
    assert one(s.token_for(F.lit("no"), F.array(F.lit("Lakers"), F.lit("Celtics")), tokens)) == "t2"
    assert one(s.keywords(F.lit("Will Ann Lee or Bo Fox win"))) == ["Will Ann Lee", "Bo Fox"] and one(s.keywords(F.lit("the longest words of it"))) == ["longest", "words", "the"]
    assert one(s.percent(F.lit(1), F.lit(8))) == "12.5%" and one(s.percent(F.lit(1), F.lit(0))) == "n/a"
    assert one(s.miss_state(F.lit(None).cast("int"), F.lit(3))) == "gap" and one(s.miss_state(F.lit(4), F.lit(3))) == "drift"


def test_executable_budgets(spark):
    """All budgets of both directions from one walk equal a walk for each, level by level."""
    rng = random.Random(11)
    books = {v: [(p, s, rng.randrange(20, 60) / 100, float(rng.randrange(1, 40)), i) for p in range(12) for i in range(rng.randrange(0, 9)) for s in (rng.choice(["bid", "ask"]),)] for v in "ab"}

    def brute(pair, yes, no, fee_leg, budget):
        a = sorted([[x[2], x[3], x[4]] for x in books[yes] if x[0] == pair and x[1] == "ask"], key=lambda x: (x[0], x[2]))
        b = sorted([[round(1 - x[2], 6), x[3], x[4]] for x in books[no] if x[0] == pair and x[1] == "bid"], key=lambda x: (x[0], x[2]))
        n = ca = cb = profit = 0.0
        while a and b:
            pa, pb = a[0][0], b[0][0]
            fee = round(0.07 * (pa, pb)[fee_leg] * (1 - (pa, pb)[fee_leg]) + 1e-12, 4)
            q = min(a[0][1], b[0][1]) if budget is None else min(a[0][1], b[0][1], (budget - ca) / pa, (budget - cb) / pb)
            if 1 - pa - pb - fee <= 1e-12 or q <= 1e-9:
                break
            n, ca, cb, profit = n + q, ca + q * pa, cb + q * pb, profit + q * (1 - pa - pb - fee)
            for leg in (a, b):
                leg[0][1] -= q
                if leg[0][1] <= 1e-9:
                    leg.pop(0)
        return n, ca, cb, profit

    schema = "pair int, side string, price double, size double, pos int"
    found = ladders.executable(spark.createDataFrame(books["a"], schema), spark.createDataFrame(books["b"], schema), (1.0, 5.0, 20.0)).collect()
    assert {(r["direction"], r["budget"]) for r in found} == {(d, b) for d in ladders.DIRECTIONS for b in (None, 1.0, 5.0, 20.0)}
    best = {}
    for r in found:
        yes, no, leg = ("a", "b", 1) if r["direction"] == "a_yes_b_no" else ("b", "a", 0)
        want = brute(r["pair"], yes, no, leg, r["budget"])
        assert [r["contracts"], r["cost_a"], r["cost_b"], r["profit"]] == pytest.approx(want, abs=0.0051)
        if r["budget"] is None:
            best.setdefault(r["pair"], []).append((-r["profit"], ladders.DIRECTIONS.index(r["direction"]), r["best"]))
    assert all(b for _, _, b in (min(x) for x in best.values())) and all(sum(b for _, _, b in x) == 1 for x in best.values())
    total = ladders.portfolio(spark.createDataFrame([("p", True, 5.0, 3.0, 1.0, 1.5, 0.4), ("p", False, 5.0, 9.0, 9.0, 9.0, 9.0), ("q", True, 5.0, 0.0, 0.0, 0.0, 0.0), ("q", True, 1.0, 2.0, 1.0, 1.0, 1.0)], "pair string, best boolean, budget double, contracts double, cost_a double, cost_b double, profit double")).first()
    assert tuple(total) == (1, 2.5, 0.4)


def test_policies_are_read_as_one_by_one(spark):
    """All policies of texts that repeat, from Arrow batches: the same as each by itself."""
    from twinbook.operators import vetoes

    texts = ["In the case of a tie the market resolves to No.", "A tie is split evenly. Most seats decide.", "", None, "Exactly 5, or more; most votes", "A tie is split evenly. Most seats decide."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.struct(*(vetoes.policy(F.coalesce("t", F.lit("")), p).alias(k) for k, (_, p) in vetoes.POLICIES.items()))
    assert all(r["x"] == r["y"] for r in rows.select(vetoes.all_policies(F.col("t")).alias("x"), one.alias("y")).collect())


def test_thresholds_read_each_pattern_once(spark):
    from twinbook.functions import features

    rows = spark.createDataFrame([("Will it be above $5,000?",), (None,)], "t string").select(features.threshold(F.col("t")).alias("b"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract(") + plan.count(" rlike ") == 0
    assert [r["b"] and tuple(r["b"]) for r in rows.collect()] == [(True, 5000.0, "usd"), None]


def test_markets_are_matched_level_by_level(spark):
    """Levels give what one greedy pass over all pairs gives, and copies far apart in time never meet on the way."""
    import random
    from datetime import datetime, timedelta

    from twinbook.operators import market_match

    rng, first = random.Random(5), datetime(2024, 1, 1)
    word = lambda: rng.choice(["ruby", "opal", "jade", "onyx", "topaz", "amber", "pearl"])
    rows = lambda start, n: [(start + i, " ".join(word() for _ in range(4)), rng.choice([None, *(first + timedelta(days=rng.randrange(1500)) for _ in range(4))])) for i in range(n)]
    left, right = rows(0, 60), rows(1000, 60)
    edges = []
    for i, x, s in left:
        for j, y, t in right:
            p, q = set(x.split()), set(y.split())
            alike, hours = len(p & q) / len(p | q), None if None in (s, t) else abs((s - t).total_seconds()) / 3600
            if alike >= 0.45 and len(p & q) / min(len(p), len(q)) >= 0.4 and (hours is None or hours <= market_match.MOST_HOURS or alike >= 0.8):
                edges.append((-(alike if hours is None else 0.7 * alike + 0.3 * max(0.0, 1 - hours / market_match.MOST_HOURS)), i, j))
    want, used = set(), set()
    for _, i, j in sorted(edges):
        if i not in used and j not in used:
            want.add((i, j))
            used |= {i, j}
    make = lambda rows: spark.createDataFrame(rows, "id long, title string, close timestamp")
    got = {(r["id_a"], r["id_b"]) for r in market_match.match_markets(make(left), make(right)).collect()}
    assert want and got == want
    copies = spark.range(400).select("id", F.lit("ruby opal jade").alias("title"), (F.lit(first) + F.make_dt_interval(F.col("id").cast("int") * 10)).alias("close"))
    (a, read_a), (b, read_b) = (market_match._classes(copies, ()) for _ in range(2))
    assert read_a.count() == 1
    level = market_match.LEVELS[0]
    kinds = market_match._kinds(read_a, read_b, level, None, 0.4, ())
    assert 400 <= market_match._edges(kinds, a, b, level, market_match.MOST_HOURS).count() <= 400 * 7


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """Walks and differences deal rows by their number, so that a task's memory stays; null and repeated ids keep their states."""
    from twinbook import dealing
    from twinbook.operators import history, ladders

    monkeypatch.setattr(dealing, "ROWS", 20)
    legs = spark.range(400).selectExpr("id div 8 as pair", "cast(id % 2 as int) as leg", "0.3D as price", "1.0D as size", "id as pos", "1 as fee_leg")
    assert ladders.stretches(legs, "pair").rdd.getNumPartitions() == 20
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    diff = history.coverage_diff(ids(1, 2, 2, None, 5), ids(2, 3, 3, None, 5))
    assert sorted(map(str, diff.collect())) == sorted(map(str, ids(1).selectExpr("id", "'closed_since' as state").union(ids(3, 3, None).selectExpr("id", "'gap'")).union(ids(None).selectExpr("id", "'closed_since'")).collect()))
    wide = history.coverage_diff(spark.range(300), spark.range(100, 400))
    assert wide.count() == 200 and wide.rdd.getNumPartitions() >= 30
