"""Matching of two venues' markets: candidates by similarity and by bounds, gates, confidence, one-to-one.

Markets are rows (id, title, close) and, if there are, label and event: texts and
a timestamp, each of which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbook.checkpoints import cut
from twinbook.functions import features
from twinbook.functions.text import jaccard, prefix_length, tokens
from twinbook.operators import conflicts, decisions
from twinbook.operators.assignment import greedy_assign
from twinbook.operators.set_blocks import alike_pairs
from twinbook.operators.similarity import ordered_sets

MOST_HOURS = decisions.MOST_HOURS
#: What of a contract the gates before the conflicts read.
_SLIM = ("bound", "settles", "no0", "yes0", "no1", "yes1", "succession", "label_key", "event_key")
#: Confidences down to which markets are matched before others are looked at. Any choice gives the same matches.
LEVELS = (0.98, 0.85, 0.7)


def token_ratio(a: Column, b: Column) -> Column:
    """Shared tokens by those of the shorter title."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def bound_candidates(left: DataFrame, right: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b): pairs of markets (id, bound) with bounds of one level and a similarity of their ``sets`` that may reach ``least``.

    Bounds meet in buckets of their unit and value (dollars in steps of a
    thousandth of their size, each with its neighbours) and a prefix token of
    both titles, so that a popular bound is no single key.
    """
    b = F.col("bound")
    step = F.when(b["unit"] == "usd", F.floor(F.log(F.greatest(F.abs(b["value"]), F.lit(1e-9))) / 0.001)).when(b["unit"] == "pct", F.floor(b["value"] / 0.05)).otherwise(b["value"].cast("long"))
    prefixes = lambda k: sets.where(F.col("side") == k).select("id", F.explode(F.slice("toks", 1, prefix_length(F.col("n"), least))).alias("token"))
    rows = lambda side, k: side.where("bound is not null").select("id", "bound", b["unit"].alias("unit"), step.alias("step")).join(prefixes(k), "id")
    x = rows(left, 0).select(F.col("id").alias("id_a"), F.col("bound").alias("ba"), "unit", "step", "token")
    y = rows(right, 1).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    both = x.join(y.select(F.col("id").alias("id_b"), F.col("bound").alias("bb"), "unit", "step", "token"), ["unit", "step", "token"])
    return both.where(features.threshold_equal(F.col("ba"), F.col("bb"))).select("id_a", "id_b").distinct()


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _classes(markets: DataFrame, rules: tuple[conflicts.Conflict, ...]) -> tuple[DataFrame, DataFrame]:
    """((id, class, close) of all markets, their classes (id, toks, bound, slim, spec)): markets that differ in nothing but their close are read once.

    ``slim`` has the columns for the gates, ``spec`` the features that the rules ask for.
    """
    texts = [c for c in ("title", "label", "event") if c in markets.columns]
    rows = markets.select("id", F.col("close").cast("timestamp").alias("close"), F.sha2(F.to_json(F.struct(*texts)), 256).alias("key"), *texts)
    # Reading costs far more than a row's bytes tell, so that all partitions are kept.
    rows = rows.repartition(_parts(markets), "key")
    named = cut(rows.groupBy("key").agg(*(F.first(c).alias(c) for c in texts)).withColumn("class", F.monotonically_increasing_id()))
    members = cut(rows.select("id", "close", "key").join(named.select("key", "class"), "key").select("id", "class", "close"))
    asked = dict.fromkeys(n for r in rules for n in (r.feature, r.other) if n)
    given = {c: F.col(c) if c in texts else F.lit(None).cast("string") for c in ("label", "event")}
    read = decisions.with_contract(named.select(F.col("class").alias("id"), F.lit(None).cast("timestamp").alias("close"), F.col("title").alias("question"), *(c.alias(n) for n, c in given.items())))
    c, toks = F.col("contract"), tokens(F.col("question"))
    scope = F.struct(c["spec"]["league"].alias("league"), c["spec"]["domains"].alias("domains"))
    slim = F.struct(*(c[n].alias(n) for n in _SLIM), toks.alias("tokens"), scope.alias("spec"))
    return members, cut(read.select("id", toks.alias("toks"), c["bound"].alias("bound"), slim.alias("slim"), F.struct(*(c["spec"][n].alias(n) for n in asked)).alias("spec")))


def _sides(a: DataFrame, b: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(id_a, a) and (id_b, b): a column of both sides, to join pairs with."""
    return tuple(s.select(F.col("id").alias(f"id_{n}"), F.col(column).alias(n)) for s, n in ((a, "a"), (b, "b")))


def _kinds(a: DataFrame, b: DataFrame, least: float, bridge: float | None, ratio: float, rules: tuple[conflicts.Conflict, ...]) -> DataFrame:
    """(class_a, class_b, similarity, inverted, exempt): pairs of classes that pass all gates but that of closes, from which some are ``exempt``.

    Alike to ``least``, or to ``bridge``, if given, with bounds that match.
    """
    pairs = alike_pairs(a, b, max(least, 1e-9))
    x, y = _sides(a, b, "slim")
    if bridge is not None:
        toks = _sides(a, b, "toks")
        led = bound_candidates(a, b, cut(ordered_sets(a, b)), bridge).join(toks[0], "id_a").join(toks[1], "id_b")
        led = led.select("id_a", "id_b", jaccard(F.col("a"), F.col("b")).alias("similarity"))
        pairs = pairs.unionByName(led.where((F.col("similarity") < max(least, 1e-9)) & (F.col("similarity") >= bridge)))
    # The gates read slim columns; features join what is left.
    rows = pairs.repartition(_parts(a), "id_a").join(x, "id_a").join(y, "id_b").where(token_ratio(F.col("a.tokens"), F.col("b.tokens")) >= ratio)
    inverted, exempt = decisions.inverted_pair(F.col("a"), F.col("b")), decisions.close_exempt(F.col("a"), F.col("b"))
    rows = rows.select("id_a", "id_b", "similarity", inverted.alias("inverted"), exempt.alias("exempt"))
    for side in _sides(a, b, "spec"):
        rows = rows.join(side, side.columns[0])
    rows = conflicts.conflicts(rows, "a", "b", rules)
    against = F.when(F.col("inverted"), F.array_except("reasons", F.array(*map(F.lit, sorted(decisions.NUMBERS))))).otherwise(F.col("reasons"))
    return rows.where(F.size(against) == 0).select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), "similarity", "inverted", "exempt")


def _edges(kinds: DataFrame, a: DataFrame, b: DataFrame, level: float, most_hours: float) -> DataFrame:
    """(id_a, id_b, similarity, confidence, inverted): the members' pairs of ``kinds`` whose closes allow it, with a confidence of ``level`` or more."""
    x, y = (s.select(F.col("id").alias(f"id_{n}"), F.col("class").alias(f"class_{n}"), F.unix_micros("close").alias(f"t_{n}")) for s, n in ((a, "a"), (b, "b")))
    rows = kinds.join(x, "class_a")
    reach = (1 - level) / 0.3
    if most_hours > 0 and reach < 1:
        # Closes further apart cannot reach the level: they meet in spans of time. Unknown ones need the similarity.
        bucket = lambda t: F.floor(F.col(t) / F.lit((reach * most_hours + 0.01) * 3.6e9))
        known = rows.where("t_a is not null").withColumn("bucket", F.explode(F.array(*(bucket("t_a") + d for d in (-1, 0, 1)))))
        near = known.join(y.where("t_b is not null").withColumn("bucket", bucket("t_b")), ["class_b", "bucket"]).drop("bucket")
        alike = rows.where(F.col("similarity") >= level)
        unknown = alike.where("t_a is null").join(y, "class_b").unionByName(alike.where("t_a is not null").join(y.where("t_b is null"), "class_b"))
        rows = near.unionByName(unknown)
    else:
        rows = rows.join(y, "class_b")
    hours = (F.col("t_a") - F.col("t_b")) / 3.6e9
    rows = rows.where(F.coalesce(F.abs(hours) <= most_hours, F.lit(True)) | F.col("exempt"))
    rows = rows.select("id_a", "id_b", "similarity", features.confidence(F.col("similarity"), hours, most_hours).alias("confidence"), "inverted")
    return rows.where(F.col("confidence") >= level)


def match_markets(
    left: DataFrame, right: DataFrame, least: float = 0.45, bridge: float = 0.25, ratio: float = 0.4, most_hours: float = MOST_HOURS,
    overrides: DataFrame | None = None, rules: tuple[conflicts.Conflict, ...] = conflicts.CONFLICTS,
) -> DataFrame:
    """(id_a, id_b, similarity, confidence, via_override, inverted): one-to-one matches of markets (id, title, close[, label, event]).

    Overrides (id_a, id_b) come first and pass every gate. Other candidates are
    titles alike to ``least``, or to ``bridge`` with equal or complementary bounds;
    they need a token ratio, closes that allow it, and no conflict, but for those
    of direction that an inverted pair has by nature. Best confidence wins, ties
    by id. ``inverted``: YES of one is NO of the other.

    As best confidence wins, markets are matched down to each of LEVELS before
    any pair below it is looked at; pairs of a level are those of markets that
    are still free. Without a limit of hours a confidence is the similarity.
    """
    (a, read_a), (b, read_b) = _classes(left, rules), _classes(right, rules)
    parts = []
    if overrides is not None:
        x, y = (s.join(_sides(r, r, "slim")[k].withColumnRenamed(f"id_{n}", "class"), "class").select(F.col("id").alias(f"id_{n}"), n) for s, r, k, n in ((a, read_a, 0, "a"), (b, read_b, 1, "b")))
        forced = overrides.join(x, "id_a").join(y, "id_b")
        inverted = decisions.inverted_pair(F.col("a"), F.col("b"))
        forced = forced.select("id_a", "id_b", jaccard(F.col("a.tokens"), F.col("b.tokens")).alias("similarity"), inverted.alias("inverted"))
        best = cut(greedy_assign(forced, "id_a", "id_b", "similarity"))
        parts.append(best.join(forced.select("id_a", "id_b", "inverted"), ["id_a", "id_b"]).withColumn("confidence", F.lit(1.0)).withColumn("via_override", F.lit(True)))
        a, b = (cut(s.join(best.select(F.col(f"id_{n}").alias("id")), "id", "left_anti")) for s, n in ((a, "a"), (b, "b")))
    # A confidence of a level takes this similarity at least, and what the closes add.
    alike = lambda level: (level - 0.3) / 0.7 - 1e-9
    levels = [v for v in LEVELS if alike(v) > least]
    for level in (*levels, 0.0):
        free = [r.join(s.select(F.col("class").alias("id")).distinct(), "id", "left_semi") for r, s in ((read_a, a), (read_b, b))]
        kinds = _kinds(*free, alike(level) if level else least, None if level else bridge, ratio, rules)
        rows = cut(_edges(kinds, a, b, level, most_hours))
        if level and rows.isEmpty():
            continue
        best = greedy_assign(rows.select("id_a", "id_b", "confidence"), "id_a", "id_b", "confidence").drop("confidence")
        parts.append(cut(best.join(rows, ["id_a", "id_b"]).withColumn("via_override", F.lit(False))))
        if level:
            a, b = (cut(s.join(parts[-1].select(F.col(f"id_{n}").alias("id")), "id", "left_anti")) for s, n in ((a, "a"), (b, "b")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("id_a", "id_b", "similarity", "confidence", "inverted", "via_override")


def oriented(quotes: DataFrame) -> DataFrame:
    """``quotes`` (bid_b, ask_b, inverted, ...) with venue b's quotes of the outcome that is venue a's YES: those of NO for inverted pairs."""
    flip = lambda own, other: F.when(F.col("inverted"), F.round(1 - F.col(other), 6)).otherwise(F.col(own))
    return quotes.withColumns({"bid_b": flip("bid_b", "ask_b"), "ask_b": flip("ask_b", "bid_b")})
