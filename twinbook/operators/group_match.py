"""Two-level matching (events, then outcomes inside them) and structured matching of games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.functions.dates import hours_between
from twinbook.functions.text import jaccard
from twinbook.operators.assignment import greedy_assign
from twinbook.operators.similarity import similarity_join

#: Weights of the two readings of an outcome pair, and the least scores they need.
TITLE_FLOOR, SCORE_FLOOR, PRICE_RANGE = 0.15, 0.35, 0.15


def outcome_scores(left: DataFrame, right: DataFrame, groups: DataFrame) -> DataFrame:
    """(id_a, id_b, score) of outcomes (event, id, toks, mid) inside the event pairs (id_a, id_b, similarity) of ``groups``.

    The score is the better of a reading by title and one by price; without both
    mid prices only the title counts.
    """
    g = groups.select(F.col("id_a").alias("event_a"), F.col("id_b").alias("event_b"), F.col("similarity").alias("g"))
    a = left.select(F.col("event").alias("event_a"), F.col("id").alias("id_a"), F.col("toks").alias("toks_a"), F.col("mid").alias("mid_a"))
    b = right.select(F.col("event").alias("event_b"), F.col("id").alias("id_b"), F.col("toks").alias("toks_b"), F.col("mid").alias("mid_b"))
    rows = g.join(a, "event_a").join(b, "event_b")
    t, price = jaccard(F.col("toks_a"), F.col("toks_b")), F.greatest(F.lit(0.0), 1 - F.abs(F.col("mid_a") - F.col("mid_b")) / PRICE_RANGE)
    rows = rows.withColumn("t", t).withColumn("p", price)
    by_title = 0.7 * F.col("t") + 0.3 * F.col("g")
    by_price = 0.5 * F.col("p") + 0.3 * F.col("g") + 0.2 * F.col("t")
    return rows.withColumn("score", F.greatest(by_title, by_price)).where((F.col("t") >= TITLE_FLOOR) & (F.col("score") >= SCORE_FLOOR)).select("id_a", "id_b", "event_a", "event_b", "score")


def match_groups(events_a: DataFrame, events_b: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, score): greedy inside each event pair, then once more over all of them.

    An edge that loses inside its event pair does not come back.
    """
    edges = outcome_scores(left, right, similarity_join(events_a, events_b, least))
    inside = edges.select(
        F.struct("event_a", "event_b", "id_a").alias("x"), F.struct("event_a", "event_b", "id_b").alias("y"), "score"
    )
    first = greedy_assign(inside, "x", "y", "score")
    return greedy_assign(first.select(F.col("x.id_a").alias("id_a"), F.col("y.id_b").alias("id_b"), "score"), "id_a", "id_b", "score")


def _only_candidates(a: DataFrame, b: DataFrame, hours: float) -> DataFrame:
    """(game_a, game_b, league_a, league_b) of games of ``a`` with one candidate in ``b``: of one key and close in time.

    Games of one key and time are one group: groups meet in buckets of time, and
    candidates are counted by groups, so that no pairs of games are made.
    """
    time = ["key", "start", "day"]
    side = lambda rows, s, **more: rows.select("key", F.col(f"start_{s}").cast("timestamp").alias("start"), F.col(f"day_{s}").alias("day"), *(v.alias(n) for n, v in more.items()))
    groups_a = side(a, "a").distinct()
    groups_b = side(b, "b", game=F.struct(F.col("game_b"), F.col("league_b"))).groupBy(*time).agg(F.count("*").alias("n"), F.min("game").alias("game"))
    groups_b = groups_b.select("key", F.col("start").alias("start_b"), F.col("day").alias("day_b"), "n", "game")
    width = max(1, int(hours * 3600))
    bucket = lambda t: F.floor(F.unix_seconds(t) / width)
    around = lambda c: F.explode(F.array(*(c + d for d in (-1, 0, 1))))
    timed = groups_a.where("start is not null").withColumn("bucket", bucket(F.col("start"))).hint("merge").join(groups_b.where("start_b is not null").withColumn("bucket", around(bucket(F.col("start_b")))), ["key", "bucket"])
    timed = timed.where(hours_between(F.col("start"), F.col("start_b")) <= hours)
    number = lambda c: F.unix_date(F.col(c))
    daily = groups_a.where("day is not null").withColumn("bucket", number("day")).hint("merge").join(groups_b.where("day_b is not null").withColumn("bucket", around(number("day_b"))), ["key", "bucket"])
    daily = daily.where("start is null or start_b is null")
    found = timed.unionByName(daily).groupBy(*time).agg(F.sum("n").alias("n"), F.min("game").alias("b"))
    rows = side(a, "a", game_a=F.col("game_a"), league_a=F.col("league_a")).alias("x").hint("merge").join(found.alias("y"), F.expr(" and ".join(f"x.{c} <=> y.{c}" for c in time)))
    rows = rows.select("game_a", "league_a", "n", "b").withColumn("n", F.expr("sum(n) over (partition by game_a)")).where("n = 1")
    return rows.select("game_a", "b.game_b", "league_a", "b.league_b")


def match_games(games_a: DataFrame, games_b: DataFrame, hours: float = 3.0) -> DataFrame:
    """Games (game, league, teams, start, day) with equal team sets, close in time, one candidate only, and of the leagues' majority.

    Known starts may differ by ``hours``, else the days by one. A pair's venue-b
    league must be the one that venue-a's league meets most often; a tie of the
    two most frequent keeps neither.
    """
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    a = games_a.select(F.col("game").alias("game_a"), F.col("league").alias("league_a"), key(F.col("teams")).alias("key"), F.col("start").alias("start_a"), F.col("day").alias("day_a"))
    b = games_b.select(F.col("game").alias("game_b"), F.col("league").alias("league_b"), key(F.col("teams")).alias("key"), F.col("start").alias("start_b"), F.col("day").alias("day_b"))
    rows = _only_candidates(a, b, hours)
    votes = rows.groupBy("league_a", "league_b").agg(F.count("*").alias("v"))
    top = votes.groupBy("league_a").agg(F.max("v").alias("best")).join(votes, "league_a").where("v = best")
    clear = top.groupBy("league_a").agg(F.count("*").alias("k"), F.max("league_b").alias("league_b")).where("k = 1").select("league_a", "league_b")
    rows = rows.join(clear, ["league_a", "league_b"])
    return rows.withColumn("m", F.expr("count(*) over (partition by game_b)")).where("m = 1").select("game_a", "game_b", "league_a", "league_b")
