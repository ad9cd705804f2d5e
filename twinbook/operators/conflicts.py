"""Conflicts between the titles of a candidate pair: a table of rules over their features.

A rule is data. Its kind says when it fires on the features of both sides:

* disjoint: both sides collect something, and share nothing;
* nested: as disjoint, but each side's set also fits if it is part of the other's;
* single: both sides name exactly one, and these differ;
* differ: cases that both sides know and that are not equal;
* only: exactly one side has the flag;
* opposed: one side has the first flag and not the second, the other the second and not the first.

A pair's reasons are the names of the rules that fire, in the order of the table;
a null title has no features, and so conflicts only where one side alone must
have something. Features are computed once per market, before the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbook.functions.features import FAMILIES, ascii_lower, spec


@dataclass(frozen=True)
class Conflict:
    name: str
    kind: str
    feature: str
    other: str = ""


CONFLICTS = (
    Conflict("year", "disjoint", "years"),
    Conflict("deadline year", "disjoint", "deadline_years"),
    Conflict("month", "disjoint", "months"),
    Conflict("day", "disjoint", "days"),
    Conflict("fiscal period", "disjoint", "fiscal"),
    Conflict("week", "disjoint", "weeks"),
    Conflict("office", "single", "office_bundle"),
    Conflict("party", "disjoint", "parties"),
    Conflict("state", "disjoint", "states"),
    Conflict("country", "disjoint", "countries"),
    Conflict("county", "disjoint", "counties"),
    Conflict("district", "disjoint", "districts"),
    Conflict("region", "disjoint", "brazil"),
    Conflict("chamber", "disjoint", "chamber"),
    Conflict("seat or control", "differ", "legislative"),
    Conflict("below state", "only", "below_state"),
    Conflict("candidacy", "only", "candidacy"),
    Conflict("nomination", "only", "nomination"),
    Conflict("exit poll", "only", "exit_poll"),
    Conflict("dismissal", "only", "dismissed"),
    Conflict("wave", "differ", "wave"),
    Conflict("central bank", "disjoint", "banks"),
    Conflict("rate move", "disjoint", "bps"),
    Conflict("rate count", "only", "rate_count"),
    Conflict("policy", "disjoint", "policy"),
    Conflict("corporate event", "differ", "corporate"),
    Conflict("organisation", "disjoint", "orgs"),
    Conflict("product", "disjoint", "products"),
    Conflict("judicial stage", "differ", "judicial"),
    Conflict("party list", "disjoint", "party_list"),
    Conflict("government", "differ", "government"),
    Conflict("speech venue", "disjoint", "speech"),
    Conflict("first endorsement", "only", "first_endorsement"),
    Conflict("competition", "differ", "competition"),
    Conflict("league", "disjoint", "league"),
    Conflict("women's", "only", "womens"),
    Conflict("club", "disjoint", "clubs"),
    Conflict("round", "disjoint", "rounds"),
    Conflict("run-off", "disjoint", "runoff"),
    Conflict("match period", "disjoint", "periods"),
    Conflict("half time", "only", "halftime"),
    Conflict("advance or fall", "opposed", "qualify", "relegated"),
    Conflict("fantasy position", "disjoint", "fantasy"),
    Conflict("season outcome", "disjoint", "season"),
    Conflict("stage", "differ", "stage"),
    Conflict("tier", "disjoint", "tier"),
    Conflict("place", "disjoint", "places"),
    Conflict("runner-up", "only", "runner_up"),
    Conflict("rank", "disjoint", "ranks"),
    Conflict("seed", "disjoint", "seeds"),
    Conflict("pick", "disjoint", "picks"),
    Conflict("set", "disjoint", "set_numbers"),
    Conflict("statistic", "disjoint", "leader_stats"),
    Conflict("superlative", "only", "superlative"),
    Conflict("player prop", "only", "player_prop"),
    Conflict("spread", "only", "spread"),
    Conflict("relative standing", "only", "relative"),
    Conflict("ceremony", "disjoint", "award_body"),
    Conflict("award", "disjoint", "award"),
    Conflict("award phrase", "nested", "award_phrases"),
    Conflict("honour", "differ", "honour"),
    Conflict("league outcome", "differ", "league_outcome"),
    Conflict("career", "differ", "f1_career"),
    Conflict("result", "differ", "golf_result"),
    Conflict("direction", "opposed", "above", "below"),
    Conflict("rate", "disjoint", "rates"),
    Conflict("money size", "disjoint", "money_size"),
    Conflict("price race", "only", "price_race"),
    Conflict("bucket or bound", "opposed", "bucket", "cumulative"),
    Conflict("vote share or place", "opposed", "is_vote_share", "places"),
    Conflict("vote share", "disjoint", "vote_share"),
    Conflict("review score", "only", "review_score"),
    Conflict("settlement", "differ", "settles"),
    Conflict("weather source", "disjoint", "weather_source"),
    Conflict("price source", "disjoint", "crypto_source"),
    Conflict("statistics source", "disjoint", "econ_source"),
)
_KIND = {n: f.kind for family in FAMILIES.values() for n, f in family.items()}


def has(side: Column, feature: str) -> Column:
    """Whether a side has a feature at all."""
    kind = _KIND[feature]
    if kind == "flag":
        return side[feature]
    return F.size(side[feature]) > 0 if kind in ("set", "labels") else side[feature].isNotNull()


def fires(rule: Conflict, a: Column, b: Column) -> Column:
    """Whether a rule fires on the specs of both sides."""
    x, y = a[rule.feature], b[rule.feature]
    if rule.kind == "only":
        return has(a, rule.feature) != has(b, rule.feature)
    if rule.kind == "opposed":
        side = lambda s, t: has(s, rule.feature) & ~has(s, rule.other) & has(t, rule.other) & ~has(t, rule.feature)
        return side(a, b) | side(b, a)
    if rule.kind == "differ":
        return F.coalesce(x != y, F.lit(False))
    if rule.kind == "single":
        return (F.size(x) == 1) & (F.size(y) == 1) & (x[0] != y[0])
    apart = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    if rule.kind == "nested":
        return apart | ((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0))
    return apart


def with_spec(markets: DataFrame, title: str = "title") -> DataFrame:
    """``markets`` with a struct ``spec`` of all features of the title."""
    # The folded title is a column of its own, so that no rule folds it again.
    return markets.withColumn("_low", ascii_lower(F.col(title))).withColumn("spec", spec(F.col(title), F.col("_low"))).drop("_low")


def conflicts(pairs: DataFrame, a: str = "spec_a", b: str = "spec_b", rules: tuple[Conflict, ...] = CONFLICTS) -> DataFrame:
    """``pairs`` with ``reasons``, the rules that fire, in order, and ``reason``, the first of them."""
    fired = F.array_compact(F.array(*(F.when(fires(r, F.col(a), F.col(b)), F.lit(r.name)) for r in rules)))
    return pairs.withColumn("reasons", fired).withColumn("reason", F.get("reasons", F.lit(0)))
