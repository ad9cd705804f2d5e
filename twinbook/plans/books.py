"""Order-book queries: levels come from lineitem, two venues and two sides for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.functions import pricing
from twinbook.functions.rungs import bucket, race_key, rung
from twinbook.operators import arbitrage, ladders, price_ladders
from twinbook.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, venue, side, price, size, pos): prices on a grid of 0.01."""
    ask = F.col("l_linenumber") % 2 == 1
    ticks = F.when(ask, 30).otherwise(42) + 2 * F.round(F.col("l_discount") * 100).cast("int") + F.round(F.col("l_tax") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pair"), F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b").alias("venue"),
        F.when(ask, "ask").otherwise("bid").alias("side"), (ticks / 100).alias("price"), F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


def legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """YES on venue a and NO on venue b."""
    rows = levels(spark, sf_dir)
    return ladders.buy_ladder(rows.where("venue = 'a'"), "yes"), ladders.buy_ladder(rows.where("venue = 'b'"), "no")


_LEVELS = """levels as (
  select l_partkey as pair, case when l_orderkey % 2 = 0 then 'a' else 'b' end as venue,
    case when l_linenumber % 2 = 1 then 'ask' else 'bid' end as side,
    cast((case when l_linenumber % 2 = 1 then 30 else 42 end) + 2 * cast(round(l_discount * 100) as int) + cast(round(l_tax * 100) as int) as double) / 100 as price,
    l_quantity as size, l_orderkey * 10 + l_linenumber as pos
  from lineitem)"""
_LEGS = f"""{_LEVELS},
leg_a as (select pair, price, size, pos from levels where venue = 'a' and side = 'ask'),
leg_b as (select pair, round(1 - price, 6) as price, size, pos from levels where venue = 'b' and side = 'bid')"""
_CHUNKS = f"""{_LEGS},
ia as (select pair, price as pa, sum(size) over w - size as lo_a, sum(size) over w as hi_a from leg_a
       window w as (partition by pair order by price, pos rows unbounded preceding)),
ib as (select pair, price as pb, sum(size) over w - size as lo_b, sum(size) over w as hi_b from leg_b
       window w as (partition by pair order by price, pos rows unbounded preceding)),
chunks as (
  select pair, greatest(lo_a, lo_b) as start, least(hi_a, hi_b) - greatest(lo_a, lo_b) as q, pa, pb,
    round(cast(0.07 as double) * pb * (1 - pb), 4) as fee, 1 - pa - pb - round(cast(0.07 as double) * pb * (1 - pb), 4) as profit
  from ia join ib using (pair) where lo_a < hi_b and lo_b < hi_a)"""
_PAYING = f"""{_CHUNKS},
paying as (
  select * from (select *, max(cast(profit <= 1e-12 as int)) over (partition by pair order by start) as stop from chunks) where stop = 0)"""
_RESULT = """round(sum(q), 4) as contracts, round(sum(q * pa), 4) as cost_a, round(sum(q * pb), 4) as cost_b,
  round(sum(q * fee), 4) as fees, round(sum(q * profit), 4) as profit"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


_MONEY = ("contracts", "cost_a", "cost_b", "fees", "profit")


@query("ladder_fill", f"with {_PAYING} select pair, {_RESULT} from paying group by pair")
def ladder_fill(spark, sf_dir):
    return _rounded(ladders.lockstep_fill(*legs(spark, sf_dir)), *_MONEY)


@query(
    "ladder_fill_budget",
    f"""with {_PAYING},
room as (
  select *, greatest(0, least(q,
      (100 - coalesce(sum(q * pa) over past, 0)) / pa, (100 - coalesce(sum(q * pb) over past, 0)) / pb)) as cap
  from paying window past as (partition by pair order by start rows between unbounded preceding and 1 preceding)),
kept as (
  select *, coalesce(max(cast(cap < q as int)) over (partition by pair order by start rows between unbounded preceding and 1 preceding), 0) as done
  from room)
select pair, round(sum(cap), 4) as contracts, round(sum(cap * pa), 4) as cost_a, round(sum(cap * pb), 4) as cost_b,
  round(sum(cap * fee), 4) as fees, round(sum(cap * profit), 4) as profit
from kept where done = 0 and cap > 0 group by pair""",
)
def ladder_fill_budget(spark, sf_dir):
    return _rounded(ladders.lockstep_fill(*legs(spark, sf_dir), budget=100.0), *_MONEY)


_BUDGETS = (20.0, 100.0, 400.0)


def _direction_sql(name: str, yes: str, no: str, fee: str) -> str:
    return f"""select '{name}' as direction, pair, greatest(lo_a, lo_b) as start, least(hi_a, hi_b) - greatest(lo_a, lo_b) as q, pa, pb, round(cast(0.07 as double) * {fee} * (1 - {fee}), 4) as fee
  from (select pair, price as pa, sum(size) over w - size as lo_a, sum(size) over w as hi_a from levels where venue = '{yes}' and side = 'ask' window w as (partition by pair order by price, pos rows unbounded preceding))
  join (select pair, round(1 - price, 6) as pb, sum(size) over w - size as lo_b, sum(size) over w as hi_b from levels where venue = '{no}' and side = 'bid' window w as (partition by pair order by round(1 - price, 6), pos rows unbounded preceding))
  using (pair) where lo_a < hi_b and lo_b < hi_a"""


_EXECUTABLE = f"""{_LEVELS},
both_ways as ({_direction_sql("a_yes_b_no", "a", "b", "pb")} union all {_direction_sql("b_yes_a_no", "b", "a", "pa")}),
walked as (
  select *, 1 - pa - pb - fee as profit, max(cast(1 - pa - pb - fee <= 1e-12 as int)) over w as stop, sum(q) over w as cum,
    coalesce(sum(q * pa) over (w rows between unbounded preceding and 1 preceding), 0) as spent_a, coalesce(sum(q * pb) over (w rows between unbounded preceding and 1 preceding), 0) as spent_b
  from both_ways window w as (partition by pair, direction order by start)),
tried as (
  select walked.*, budget, case when stop = 1 then 0 when budget is null then q else greatest(0, least(q, (budget - spent_a) / pa, (budget - spent_b) / pb)) end as take
  from walked, unnest([null, {", ".join(map(str, _BUDGETS))}]) as limits(budget)),
filled as (
  select pair, direction, budget, sum(take) as n, sum(take * pa) as a, sum(take * pb) as b, sum(take * profit) as p, arg_min(profit, start) as top, coalesce(max(cum) filter (pa + pb + fee < 1 - 1e-12), 0) as breakeven from tried group by 1, 2, 3),
best as (select pair, arg_min(direction, (-round(p + 1e-9, 4), direction)) as best_direction from filled where budget is null group by 1),
executable as (
  select pair, direction, budget, round(n + 1e-9, 4) as contracts, case when n > 0 then round(a / n + 1e-9, 6) else 0 end as vwap_a, case when n > 0 then round(b / n + 1e-9, 6) else 0 end as vwap_b, round(a + 1e-9, 2) as cost_a, round(b + 1e-9, 2) as cost_b, round(p + 1e-9, 4) as profit,
    case when a + b > 0 then round(p / (a + b) + 1e-9, 6) else 0 end as roi, round(top + 1e-9, 6) as top_net, breakeven, direction = best_direction as best from filled join best using (pair))"""
_FILL = ("contracts", "vwap_a", "vwap_b", "cost_a", "cost_b", "profit", "roi", "top_net", "breakeven", "best")


def _executable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levels(spark, sf_dir)
    return ladders.executable(rows.where("venue = 'a'"), rows.where("venue = 'b'"), _BUDGETS)


@query("book_arb", f"with {_EXECUTABLE} select pair, direction, budget, {', '.join(_FILL)} from executable")
def book_arb(spark, sf_dir):
    """Both directions of every pair with all budgets, from one walk."""
    return _executable(spark, sf_dir).select("pair", "direction", "budget", *_FILL)


@query("portfolio_totals", f"with {_EXECUTABLE} select count(*) as pairs, round(sum(cost_a + cost_b), 0) as deployed, round(sum(profit), 1) as profit from executable where best and contracts > 0 and budget = {_BUDGETS[-1]}")
def portfolio_totals(spark, sf_dir):
    return ladders.portfolio(_executable(spark, sf_dir)).select("pairs", F.round("deployed", 0).alias("deployed"), F.round("profit", 1).alias("profit"))


@query(
    "ladder_curve",
    f"""with {_CHUNKS} select pair, row_number() over w as seq, sum(q) over w as cum, pa, pb, round(pa + pb + fee, 4) as combined
from chunks window w as (partition by pair order by start)""",
)
def ladder_curve(spark, sf_dir):
    return _rounded(ladders.cumulative_curve(*legs(spark, sf_dir)), "combined")


@query(
    "ladder_breakeven",
    f"""with {_CHUNKS}, curve as (
  select pair, start, sum(q) over (partition by pair order by start) as cum, pa + pb + fee as combined from chunks)
select pair, arg_max(cum, start) as breakeven from curve where combined < 1 - 1e-12 group by pair""",
)
def ladder_breakeven(spark, sf_dir):
    return ladders.breakeven_contracts(ladders.cumulative_curve(*legs(spark, sf_dir)))


@query(
    "ladder_vwap",
    f"""with {_LEGS}, walked as (
  select pair, price, greatest(0, least(size, 60 - coalesce(sum(size) over (partition by pair order by price, pos rows between unbounded preceding and 1 preceding), 0))) as take
  from leg_a)
select pair, sum(take) as filled, round(sum(take * price), 4) as cost, round(sum(take * price) / sum(take), 8) as price from walked where take > 0 group by pair""",
)
def ladder_vwap(spark, sf_dir):
    rows = ladders.vwap(legs(spark, sf_dir)[0], F.lit(60.0))
    return rows.withColumns({"cost": F.round("cost", 4), "price": F.round("price", 8)})


@query(
    "edge_at_size",
    f"""with {_LEGS}, both_legs as (select 'a' as leg, * from leg_a union all select 'b' as leg, * from leg_b),
walked as (
  select leg, pair, price, greatest(0, least(size, 60 - coalesce(sum(size) over (partition by leg, pair order by price, pos rows between unbounded preceding and 1 preceding), 0))) as take
  from both_legs),
prices as (select leg, pair, sum(take * price) / sum(take) as v from walked where take > 0 group by leg, pair having sum(take) >= 60)
select a.pair, round(1 - a.v - b.v - round(cast(0.07 as double) * b.v * (1 - b.v), 4), 6) as net from prices a join prices b using (pair) where a.leg = 'a' and b.leg = 'b'""",
)
def edge_at_size(spark, sf_dir):
    return ladders.edge_at_size(*legs(spark, sf_dir), 60.0).select("pair", "net")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levels(spark, sf_dir)
    top = lambda v: ladders.top_of_book(rows.where(F.col("venue") == v)).select("pair", F.col("bid").alias(f"bid_{v}"), F.col("ask").alias(f"ask_{v}"))
    return top("a").join(top("b"), "pair", "full_outer")


_QUOTES = f"""{_LEVELS},
quotes as (
  select pair, max(price) filter (venue = 'a' and side = 'bid') as bid_a, min(price) filter (venue = 'a' and side = 'ask') as ask_a,
    max(price) filter (venue = 'b' and side = 'bid') as bid_b, min(price) filter (venue = 'b' and side = 'ask') as ask_b
  from levels group by pair)"""
_DIRECTIONS = f"""{_QUOTES},
directions as (
  select *, round(gross - fee, 6) as net from (
    select pair, 0 as place, 'a_yes' as direction, ask_a as cost_yes, 1 - bid_b as cost_no, round(cast(0.07 as double) * (1 - bid_b) * bid_b, 4) as fee, round(1 - ask_a - (1 - bid_b), 6) as gross from quotes
    union all
    select pair, 1, 'b_yes', ask_b, 1 - bid_a, round(cast(0.07 as double) * ask_b * (1 - ask_b), 4), round(1 - ask_b - (1 - bid_a), 6) from quotes)
  where cost_yes is not null and cost_no is not null)"""


@query("top_of_book", f"with {_QUOTES} select * from quotes")
def top_of_book(spark, sf_dir):
    return quotes(spark, sf_dir)


@query("find_arb", f"with {_DIRECTIONS} select pair, direction, gross, fee, net from directions where net >= 0.05")
def find_arb(spark, sf_dir):
    return arbitrage.find_arb(quotes(spark, sf_dir), 0.05).select("pair", "direction", "gross", "fee", "net")


@query(
    "best_direction",
    f"with {_DIRECTIONS} select pair, direction, net from (select *, row_number() over (partition by pair order by net desc, place) as rn from directions) where rn = 1",
)
def best_direction(spark, sf_dir):
    return arbitrage.best_direction(quotes(spark, sf_dir)).select("pair", "direction", "net")


@query(
    "inverted_pairs",
    f"""with {_QUOTES} select pair, case when pair % 3 = 0 then round(1 - ask_b, 6) else bid_b end as bid_b,
  case when pair % 3 = 0 then round(1 - bid_b, 6) else ask_b end as ask_b from quotes""",
)
def inverted_pairs(spark, sf_dir):
    rows = quotes(spark, sf_dir).withColumn("inverted", F.col("pair") % 3 == 0)
    return arbitrage.flip(rows, "inverted").select("pair", "bid_b", "ask_b")


@query(
    "book_quotes",
    f"""with {_LEVELS}, q as (
  select pair, venue, max(price) filter (side = 'bid') as bid, min(price) filter (side = 'ask') as ask from levels group by pair, venue)
select pair, venue, bid, ask, round((bid + ask) / 2, 6) as mid, round(ask - bid, 6) as spread from q""",
)
def book_quotes(spark, sf_dir):
    raw = F.transform(F.array_agg(F.struct(F.col("price").cast("string").alias("p"), F.col("size").cast("string").alias("s"))), lambda x: F.array(x["p"], x["s"]))
    rows = levels(spark, sf_dir).groupBy("pair", "venue", "side").agg(raw.alias("raw"))
    pick = lambda side: F.first(F.when(F.col("side") == side, F.col("raw")), ignorenulls=True)
    empty = F.expr("array()").cast("array<array<string>>")
    book = rows.groupBy("pair", "venue").agg(F.coalesce(pick("bid"), empty).alias("b"), F.coalesce(pick("ask"), empty).alias("a")).select(
        "pair", "venue", F.struct(pricing.parse_side(F.col("b"), True).alias("bids"), pricing.parse_side(F.col("a"), False).alias("asks")).alias("book")
    )
    b = F.col("book")
    return book.select("pair", "venue", pricing.best_bid(b).alias("bid"), pricing.best_ask(b).alias("ask"), pricing.mid(b).alias("mid"), pricing.spread(b).alias("spread"))


def rungs_and_buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    buckets = part.select(
        F.col("p_brand").alias("race"), F.col("p_size").cast("double").alias("lo"),
        F.when(F.col("p_size") >= 45, F.lit(float("inf"))).otherwise(F.col("p_size") + F.col("p_partkey") % 5 + 1.0).alias("hi"),
        F.when(F.col("p_partkey") % 17 > 0, (F.col("p_partkey") % 10) / 100).alias("ask"), ((F.col("p_partkey") % 7) / 100).alias("bid"),
    )
    rungs = part.select(F.col("p_brand").alias("race"), (F.col("p_size") % 6 * 8).cast("double").alias("threshold")).distinct()
    return rungs, buckets


_BUCKETS = """buckets as (
  select p_brand as race, cast(p_size as double) as lo, case when p_size >= 45 then cast('inf' as double) else p_size + p_partkey % 5 + 1.0 end as hi,
    case when p_partkey % 17 > 0 then cast(p_partkey % 10 as double) / 100 end as ask, cast(p_partkey % 7 as double) / 100 as bid from part),
rungs as (select distinct p_brand as race, cast(p_size % 6 * 8 as double) as threshold from part)"""


@query(
    "ladder_baskets",
    f"""with {_BUCKETS}
select race, threshold, count(*) filter (lo >= threshold) as n_above, count(*) filter (lo < threshold) as n_straddle,
  round(sum(bid) filter (lo >= threshold), 4) as above_bid,
  case when count(*) filter (lo >= threshold) = count(ask) filter (lo >= threshold) then round(sum(ask) filter (lo >= threshold), 4) end as above_ask,
  case when count(*) = count(ask) then round(sum(ask), 4) end as sup_ask
from rungs join buckets using (race) where hi > threshold group by race, threshold""",
)
def ladder_baskets(spark, sf_dir):
    return _rounded(price_ladders.baskets(*rungs_and_buckets(spark, sf_dir)), "above_bid", "above_ask", "sup_ask")


#: Rungs and buckets as two catalogs label them; a rung's quotes follow from its threshold.
_RACES = """parts as (select *, p_brand || case when p_partkey % 2 = 0 then ' Senate' else ' Governor' end as race, case p_partkey % 3 when 0 then 'republican' when 1 then 'democrat' else 'ann lee' end as side from part),
buckets as (
  select race, side, p_partkey as id, bid, ask,
    case p_partkey % 19 when 3 then 0.0 when 4 then 0.0 else p_size end::double as lo, case when p_partkey % 19 in (4, 5) then cast('inf' as double) when p_partkey % 19 = 3 then p_size else p_size + p_partkey % 9 + 1 end::double as hi
  from (select *, case when p_partkey % 17 > 0 then cast(p_partkey % 10 as double) / 100 end as ask, case when p_partkey % 23 > 0 then cast(p_partkey % 7 as double) / 100 end as bid from parts) where p_partkey % 29 > 0),
rungs as (select distinct race, side, (p_size % 6 * 8)::double as threshold from parts)"""


def race_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rung markets, bucket markets) made of part: (event_title, label, floor_strike, bid, ask) and (id, event_title, label, bid, ask)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    race = F.concat("p_brand", F.when(k % 2 == 0, " Senate").otherwise(" Governor"))
    part = table(spark, sf_dir, "part").select("*", race.alias("race"), F.when(k % 3 == 0, "Republican").when(k % 3 == 1, "Democrat").otherwise("Ann Lee").alias("side"))
    tick = (size % 6 * 8) % 50 / 100
    rungs = part.select(
        F.concat("race", F.lit(" margin of victory")).alias("event_title"), F.concat("side", F.when(F.col("side") == "Ann Lee", "").otherwise("s"), F.lit(", "), (size % 6 * 8).cast("int").cast("string"), F.lit("+ pts")).alias("label"),
        F.when(size % 2 == 0, (size % 6 * 8).cast("double")).alias("floor_strike"), F.round(0.2 + tick, 2).alias("bid"), F.round(0.25 + tick, 2).alias("ask"),
    ).dropDuplicates(["event_title", "label"])
    n = size.cast("int").cast("string")
    form = F.when(k % 19 == 3, F.concat("side", F.lit(" <"), n, F.lit("%"))).when(k % 19 == 4, F.concat("side", F.lit(" Wins"))).when(k % 19 == 5, F.concat("side", F.lit(" "), n, F.lit("%+")))
    form = F.when(k % 29 == 0, F.concat("side", F.lit(" something"))).otherwise(form.otherwise(F.concat("side", F.lit(" "), n, F.lit("-"), (size + k % 9 + 1).cast("int").cast("string"), F.lit("%"))))
    buckets = part.select(
        k.alias("id"), F.concat(F.lit("The 2026 "), "race", F.lit(" Election Margin of Victory")).alias("event_title"), form.alias("label"),
        F.when(k % 23 > 0, (k % 7) / 100).alias("bid"), F.when(k % 17 > 0, (k % 10) / 100).alias("ask"),
    )
    return rungs, buckets


def _synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs, buckets = race_catalogs(spark, sf_dir)
    read = rungs.select(race_key(F.col("event_title")).alias("race"), rung(F.col("label"), F.col("floor_strike")).alias("r"), F.col("label").alias("title"), "bid", "ask").where("r is not null")
    read = read.select("race", "r.*", F.concat("race", F.lit("/"), "title").alias("id"), "title", "bid", "ask")
    held = buckets.select(race_key(F.col("event_title")).alias("race"), bucket(F.col("label")).alias("b"), "id", "label", "bid", "ask").where("b is not null").select("race", "b.*", "id", "label", "bid", "ask")
    return price_ladders.synthesize(read, held)


_RECORDS = f"""{_RACES},
legs as (
  select r.race, r.side, threshold, lo, hi, bid, ask, id, max(hi) over (partition by r.race, r.side, threshold order by lo, hi, id rows between unbounded preceding and 1 preceding) as reach
  from rungs r join buckets b on r.race = b.race and r.side = b.side and (lo >= threshold or (lo < threshold and threshold < hi))),
records as (
  select lower(race) as race, side, threshold, count(*) filter (lo < threshold) = 0 as exact,
    case when count(*) filter (lo >= threshold) > 0 and count(*) filter (lo >= threshold and bid is null) = 0 then round(sum(bid) filter (lo >= threshold), 4) end as sub_bid,
    case when count(*) filter (ask is null) = 0 and not coalesce(bool_or(reach < lo), false) and max(hi) = cast('inf' as double) then round(sum(ask), 4) end as sup_ask,
    coalesce(string_agg(id, ',' order by lo, hi, id) filter (lo >= threshold), '') as sub_legs, string_agg(id, ',' order by lo, hi, id) as sup_legs
  from legs group by 1, 2, 3)"""


@query("ladder_synthesis", f"with {_RECORDS} select * from records where sub_bid is not null or sup_ask is not null")
def ladder_synthesis(spark, sf_dir):
    found = _synthesis(spark, sf_dir)
    return found.select("race", "side", "threshold", "exact", "sub_bid", "sup_ask", F.array_join("sub_legs", ",").alias("sub_legs"), F.array_join("sup_legs", ",").alias("sup_legs"))


@query(
    "ladder_edges",
    f"""with {_RECORDS},
quoted as (select *, round(0.2 + (threshold % 50) / 100, 2) as bid, round(0.25 + (threshold % 50) / 100, 2) as ask from records),
both_ways as (select *, sub_bid - ask - 0.07 * ask * (1 - ask) as buy, bid - sup_ask - 0.07 * (1 - bid) * bid as sell from quoted)
select race, side, threshold, case when sell is null or buy >= sell then 'buy rung' else 'sell rung' end as direction, round(greatest(buy, sell), 4) as edge, case when sell is null or buy >= sell then sub_legs else sup_legs end as legs
from both_ways where buy is not null or sell is not null""",
)
def ladder_edges(spark, sf_dir):
    found = price_ladders.edges(_synthesis(spark, sf_dir))
    return found.select("race", "side", "threshold", "direction", "edge", F.array_join("legs", ",").alias("legs"))


@query(
    "ladder_coverage",
    f"""with {_BUCKETS}, walked as (
  select race, lo, hi, max(hi) over (partition by race order by lo, hi rows between unbounded preceding and 1 preceding) as reach from buckets)
select race, not bool_or(reach is not null and reach < lo) and max(hi) = cast('inf' as double) as covered from walked group by race""",
)
def ladder_coverage(spark, sf_dir):
    return price_ladders.covers_tail(rungs_and_buckets(spark, sf_dir)[1], ["race"])


def _above(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("event"), F.col("l_quantity").cast("int").alias("level"))
    hundredths = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    return rows.agg((F.floor(hundredths * 5 / F.count("*")) / 100).alias("above"))


_ABOVE = """above as (
  select l_returnflag || l_linestatus as event, cast(l_quantity as int) as level,
    floor(cast(sum(cast(round(l_discount * 100) as bigint)) * 5 as double) / count(*)) / 100 as above
  from lineitem group by 1, 2)"""


@query(
    "ladder_distribution",
    f"""with {_ABOVE} select event, level, greatest(0, round(lag(above, 1, 1.0) over (partition by event order by level) - above, 6)) as probability from above""",
)
def ladder_distribution(spark, sf_dir):
    return price_ladders.distribution(_above(spark, sf_dir)).withColumn("probability", F.round("probability", 6))


@query(
    "ladder_monotonicity",
    f"""with {_ABOVE}, walked as (
  select event, lag(level) over w as low, level as high, lag(above) over w as p_low, above as p_high from above window w as (partition by event order by level))
select * from walked where p_high > p_low""",
)
def ladder_monotonicity(spark, sf_dir):
    return price_ladders.monotonicity_violations(_above(spark, sf_dir))
