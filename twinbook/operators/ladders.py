"""Walks over order-book ladders: lockstep fills, curves, depth-weighted prices.

A ladder is a DataFrame (pair, price, size, pos): what one leg costs, level by
level. Both legs of a pair are walked together, as break points of one line of
running sizes; no level is compared with all levels of the other leg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinbook.dealing import dealt
from twinbook.functions.pricing import taker_fee


def buy_ladder(levels: DataFrame, outcome: str) -> DataFrame:
    """Cost levels of buying an outcome from (pair, side, price, size, pos): YES takes asks, NO takes 1 - bid."""
    if outcome == "yes":
        rows = levels.where("side = 'ask' and size > 0")
    else:
        rows = levels.where("side = 'bid' and size > 0").withColumn("price", F.round(1 - F.col("price"), 6))
    return rows.select("pair", "price", "size", "pos")


def stretches(legs: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, q, pa, pb, fee, profit): stretches of quantity with one price on each leg, cheapest first.

    ``legs`` are (keys, leg, price, size, pos, fee_leg): leg 0 and leg 1, and the
    one on the venue that takes the variable fee. Both legs' running sizes are
    break points of one line, which is walked once from its end: a stretch costs
    what the last levels seen of either leg cost.
    """
    rows = dealt(legs, keys[0])
    rows = rows.withColumn("hi", F.sum("size").over(W.partitionBy(*keys, "leg").orderBy("price", "pos").rowsBetween(W.unboundedPreceding, 0)))
    down = W.partitionBy(*keys).orderBy(F.desc("hi"))
    seen = lambda k: F.last(F.when(F.col("leg") == k, F.col("price")), ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0))
    start = F.lead("hi", 1, 0.0).over(down)
    rows = rows.select(*keys, "fee_leg", start.alias("start"), (F.col("hi") - start).alias("q"), seen(0).alias("pa"), seen(1).alias("pb")).where("q > 0 and pa is not null and pb is not null")
    fee = taker_fee(F.when(F.col("fee_leg") == 0, F.col("pa")).otherwise(F.col("pb")))
    return rows.select(*keys, "start", "q", "pa", "pb", fee.alias("fee"), (1 - F.col("pa") - F.col("pb") - fee).alias("profit"))


def chunks(leg_a: DataFrame, leg_b: DataFrame, fee_leg: str = "b") -> DataFrame:
    """``stretches`` of two legs (pair, price, size, pos); ``fee_leg`` names the one on the venue that takes the variable fee."""
    leg = lambda rows, k: rows.select("pair", "price", "size", "pos", F.lit(k).alias("leg"), F.lit(int(fee_leg == "b")).alias("fee_leg"))
    return stretches(leg(leg_a, 0).unionAll(leg(leg_b, 1)), "pair")


def lockstep_fill(leg_a: DataFrame, leg_b: DataFrame, fee_leg: str = "b", budget: float | None = None) -> DataFrame:
    """Per pair: contracts, cost_a, cost_b, fees and profit of buying both legs together until it stops paying.

    The walk ends at the first stretch without profit. A budget limits each leg's
    cost; the stretch that exceeds it is filled in part and ends the walk.
    """
    order = W.partitionBy("pair").orderBy("start")
    rows = chunks(leg_a, leg_b, fee_leg)
    rows = rows.withColumn("stop", F.max((F.col("profit") <= 1e-12).cast("int")).over(order)).where("stop = 0")
    if budget is not None:
        past = order.rowsBetween(W.unboundedPreceding, -1)
        spent = lambda p: F.coalesce(F.sum(F.col("q") * F.col(p)).over(past), F.lit(0.0))
        room = lambda p: (F.lit(budget) - spent(p)) / F.col(p)
        rows = rows.withColumn("cap", F.greatest(F.lit(0.0), F.least("q", room("pa"), room("pb"))))
        rows = rows.withColumn("cut", F.coalesce(F.max((F.col("cap") < F.col("q")).cast("int")).over(past), F.lit(0)))
        rows = rows.where("cut = 0 and cap > 0").withColumn("q", F.col("cap"))
    q = F.col("q")
    return rows.groupBy("pair").agg(
        F.sum(q).alias("contracts"), F.sum(q * F.col("pa")).alias("cost_a"), F.sum(q * F.col("pb")).alias("cost_b"),
        F.sum(q * F.col("fee")).alias("fees"), F.sum(q * F.col("profit")).alias("profit"),
    )


def cumulative_curve(leg_a: DataFrame, leg_b: DataFrame, fee_leg: str = "b") -> DataFrame:
    """(pair, seq, cum, pa, pb, combined): the whole curve, profitable or not."""
    w = W.partitionBy("pair").orderBy("start")
    rows = chunks(leg_a, leg_b, fee_leg)
    return rows.select(
        "pair", F.row_number().over(w).alias("seq"), F.sum("q").over(w).alias("cum"), "pa", "pb", (F.col("pa") + F.col("pb") + F.col("fee")).alias("combined")
    )


def breakeven_contracts(curve: DataFrame) -> DataFrame:
    """Per pair the last quantity at which both legs together cost less than one."""
    return curve.where(F.col("combined") < 1 - 1e-12).groupBy("pair").agg(F.max_by("cum", "seq").alias("breakeven"))


def vwap(ladder: DataFrame, quantity: Column) -> DataFrame:
    """(pair, filled, cost, price): buying ``quantity`` from the cheapest levels, or what there is."""
    w = W.partitionBy("pair").orderBy("price", "pos").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(w), F.lit(0.0))
    take = F.greatest(F.lit(0.0), F.least(F.col("size"), quantity - before))
    rows = ladder.withColumn("take", take).where("take > 0")
    out = rows.groupBy("pair").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("cost"))
    return out.withColumn("price", F.col("cost") / F.col("filled"))


def edge_at_size(leg_a: DataFrame, leg_b: DataFrame, quantity: float, fee_leg: str = "b") -> DataFrame:
    """(pair, net, va, vb): edge per contract, to six places, at a quantity that both legs can fill; other pairs are left out.

    The fee is that of the mean price on ``fee_leg``. No quantity, no rows.
    """
    a, b = (vwap(x, F.lit(quantity)).where(F.col("filled") + 1e-9 >= quantity).select("pair", F.col("price").alias(n)) for x, n in ((leg_a, "va"), (leg_b, "vb")))
    net = F.round(1 - F.col("va") - F.col("vb") - taker_fee(F.col(f"v{fee_leg}")), 6)
    return a.join(b, "pair").where(F.lit(quantity > 0)).select("pair", net.alias("net"), "va", "vb")


def _even(x: Column, places: int) -> Column:
    """Rounded half up; values within 1e-9 of a half count as halves, so that sums in any order round alike."""
    return F.round(x + 1e-9, places)


def fills(walked: DataFrame, budgets: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, budget, contracts, vwap_a, vwap_b, cost_a, cost_b, profit, roi, top_net, breakeven): every budget's fill, from one walk over ``stretches``.

    A null budget is the whole profitable depth. What a budget buys of a stretch
    follows from what the stretches before it cost, so that all budgets are sums
    over the same rows. ``top_net`` is the edge at the best prices, ``breakeven``
    the quantity up to which both legs together cost less than one.
    """
    order = W.partitionBy(*keys).orderBy("start")
    past, q, pa, pb = order.rowsBetween(W.unboundedPreceding, -1), F.col("q"), F.col("pa"), F.col("pb")
    before = lambda x: F.coalesce(F.sum(x).over(past), F.lit(0.0))
    rows = walked.select(
        "*", F.max((F.col("profit") <= 1e-12).cast("int")).over(order).alias("stop"), before(q * pa).alias("spent_a"), before(q * pb).alias("spent_b"), F.sum("q").over(order).alias("cum"),
    )
    pays = F.col("stop") == 0
    bought = {None: q} | {b: F.greatest(F.lit(0.0), F.least(q, (F.lit(float(b)) - F.col("spent_a")) / pa, (F.lit(float(b)) - F.col("spent_b")) / pb)) for b in budgets}
    sums = []
    for i, take in enumerate(bought.values()):
        sums += [F.coalesce(F.sum(F.when(pays, take * x)), F.lit(0.0)).alias(f"{n}{i}") for n, x in (("n", F.lit(1.0)), ("a", pa), ("b", pb), ("p", F.col("profit")))]
    first = F.min_by(F.col("profit"), "start")
    found = rows.groupBy(*keys).agg(*sums, _even(first, 6).alias("top_net"), F.coalesce(F.max(F.when(pa + pb + F.col("fee") < 1 - 1e-12, F.col("cum"))), F.lit(0.0)).alias("breakeven"))

    def fill(i: int, budget: float | None) -> Column:
        n, a, b, profit = (F.col(f"{c}{i}") for c in "nabp")
        mean = lambda cost: F.when(n > 0, _even(cost / n, 6)).otherwise(0.0)
        return F.struct(
            F.lit(budget).cast("double").alias("budget"), _even(n, 4).alias("contracts"), mean(a).alias("vwap_a"), mean(b).alias("vwap_b"), _even(a, 2).alias("cost_a"), _even(b, 2).alias("cost_b"),
            _even(profit, 4).alias("profit"), F.when(a + b > 0, _even(profit / (a + b), 6)).otherwise(0.0).alias("roi"),
        )

    each = F.explode(F.array(*(fill(i, b) for i, b in enumerate(bought))))
    return found.select(*keys, each.alias("fill"), "top_net", "breakeven").select(*keys, "fill.*", "top_net", "breakeven")


BUDGETS = (1000.0, 2000.0, 2500.0, 5000.0)
DIRECTIONS = ("a_yes_b_no", "b_yes_a_no")


def executable(levels_a: DataFrame, levels_b: DataFrame, budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """``fills`` in both directions of the books (pair, side, price, size, pos) of two venues, b's with the variable fee.

    The first leg buys YES, the second NO. ``best`` marks the direction of the
    greater profit without a budget, of equal ones the first. Both directions are
    walked together; pairs without depth on both legs of a direction have no rows.
    """
    parts = []
    for name, yes, no, fee_leg in ((DIRECTIONS[0], levels_a, levels_b, 1), (DIRECTIONS[1], levels_b, levels_a, 0)):
        for k, leg in enumerate((buy_ladder(yes, "yes"), buy_ladder(no, "no"))):
            parts.append(leg.select("pair", F.lit(name).alias("direction"), F.lit(k).alias("leg"), "price", "size", "pos", F.lit(fee_leg).alias("fee_leg")))
    legs = parts[0]
    for part in parts[1:]:
        legs = legs.unionAll(part)
    found = fills(stretches(legs, "pair", "direction"), budgets, "pair", "direction")
    most = F.struct(F.max(F.when(F.col("budget").isNull(), F.col("profit"))).over(W.partitionBy("pair", "direction")).alias("profit"), (F.col("direction") == DIRECTIONS[0]).alias("first"))
    return found.withColumn("_rank", most).withColumn("best", F.col("_rank") == F.max("_rank").over(W.partitionBy("pair"))).drop("_rank")


def portfolio(found: DataFrame) -> DataFrame:
    """One row (pairs, deployed, profit): what all pairs take and bring in their best direction at the largest budget; those without a fill do not count."""
    counts = F.col("best") & (F.col("contracts") > 0)
    each = found.groupBy("budget").agg(F.count_if(counts).alias("pairs"), F.sum(F.when(counts, F.col("cost_a") + F.col("cost_b"))).alias("deployed"), F.sum(F.when(counts, F.col("profit"))).alias("profit"))
    largest = each.agg(F.max_by(F.struct("pairs", "deployed", "profit"), "budget").alias("x"))
    money = lambda x: F.coalesce(F.round(x, 2), F.lit(0.0))
    return largest.select(F.coalesce("x.pairs", F.lit(0)).alias("pairs"), money(F.col("x.deployed")).alias("deployed"), money(F.col("x.profit")).alias("profit"))


def top_of_book(levels: DataFrame) -> DataFrame:
    """(pair, bid, ask): the best quotes."""
    best = lambda f, side: f(F.when(F.col("side") == side, F.col("price")))
    return levels.where("size > 0").groupBy("pair").agg(best(F.max, "bid").alias("bid"), best(F.min, "ask").alias("ask"))
