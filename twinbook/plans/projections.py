"""Snapshot queries: catalog rows from orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinbook.functions import snapshots
from twinbook.operators import history, reviews
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


@query(
    "market_snapshots",
    r"""with m as (select p_partkey as id, p_name, p_type, p_brand, case p_partkey % 4 when 0 then p_name || ' wins' when 1 then 'Will it win, win or win ' || p_name when 2 then 'yes ' || p_name || ', no other ' else 'Box score ' || p_name end as title,
  case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_brand end as sub, (case when p_partkey % 5 = 0 then 'mve' else 'kx' end) || '-' || p_partkey as ticker from part)
select id, trim(case when sub is not null and sub <> '' and not contains(lower(title), lower(sub)) then trim(title) || ' ' || sub else trim(title) end) as title,
  case when upper(ticker) like 'MVE%' then 'mve' when regexp_matches(title, '(?i)^(?:yes|no) [^,]+,\s*(?:yes|no) ') then 'parlay_title' when regexp_matches(title, '(?i)\b(?:stat line|box score|stats only)\b') then 'stats_only' end as hold,
  regexp_matches(title, '(?i)^(?:yes|no) [^,]+,\s*(?:yes|no) ') or len(regexp_extract_all(title, '(?i)(\bwin\b)', 1)) >= 3 or regexp_matches(title, '(?i)\band will\b') as parlay,
  case when id % 2 = 0 then 'S' || id else string_split(ticker, '-')[1] end as series,
  ticker || '|' || case when id % 7 = 0 then cast(id as varchar) else 't' || id end as key
from m""",
)
def market_snapshots(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    form = F.when(k % 4 == 0, F.concat("p_name", F.lit(" wins"))).when(k % 4 == 1, F.concat(F.lit("Will it win, win or win "), "p_name"))
    form = form.when(k % 4 == 2, F.concat(F.lit("yes "), "p_name", F.lit(", no other "))).otherwise(F.concat(F.lit("Box score "), "p_name"))
    sub, name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_brand")), k.cast("string")
    ticker = F.concat(F.when(k % 5 == 0, "mve").otherwise("kx"), F.lit("-"), name)
    rows = part.select(k.alias("id"), form.alias("title"), sub.alias("sub"), ticker.alias("ticker"), name.alias("name"))
    return rows.select(
        "id", snapshots.market_title(F.col("title"), F.col("sub")).alias("title"), snapshots.hold_reason(F.col("ticker"), F.col("title")).alias("hold"), snapshots.is_parlay(F.col("title")).alias("parlay"),
        snapshots.event_series(F.when(F.col("id") % 2 == 0, F.concat(F.lit("S"), "name")), F.col("ticker")).alias("series"),
        snapshots.pair_key(F.col("ticker"), F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("t"), "name")), F.col("name")).alias("key"),
    )


@query(
    "catalog_edges",
    """with q as (select l_orderkey * 10 + l_linenumber as id, case when l_linenumber <> 3 then cast(40 + cast(round(l_discount * 100) as int) as double) / 100 end as bid_a, cast(45 + cast(round(l_tax * 100) as int) as double) / 100 as ask_a,
  case when l_linenumber <> 5 then cast(46 + cast(round(l_tax * 100) as int) as double) / 100 end as bid_b, cast(50 + cast(round(l_discount * 100) as int) as double) / 100 as ask_b, l_returnflag = 'R' as stale from lineitem),
e as (select *, round(greatest(bid_b - ask_a, bid_a - ask_b), 6) as edge, bid_b is null or bid_a is null as needs_fetch from q)
select id, edge, needs_fetch, needs_fetch or stale or coalesce(edge >= -0.005, false) as enrich from e""",
)
def catalog_edges(spark, sf_dir):
    cents = lambda c, base: (base + F.round(F.col(c) * 100).cast("int")) / 100
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.when(n != 3, cents("l_discount", 40)).alias("bid_a"), cents("l_tax", 45).alias("ask_a"), F.when(n != 5, cents("l_tax", 46)).alias("bid_b"),
        cents("l_discount", 50).alias("ask_b"), (F.col("l_returnflag") == "R").alias("stale"),
    )
    rows = rows.withColumn("e", snapshots.catalog_edge(*(F.col(c) for c in ("bid_a", "ask_a", "bid_b", "ask_b"))))
    return rows.select("id", "e.edge", "e.needs_fetch", snapshots.to_enrich(F.col("e"), F.col("stale"), 0.005).alias("enrich"))


@query(
    "event_closes",
    """with e as (select o_orderkey as event, case when o_orderkey % 4 = 0 then o_orderdate end as own, max(l_shipdate) as latest, o_custkey % 2 = 0 as game, o_orderdate from orders left join lineitem on l_orderkey = o_orderkey group by all)
select event, coalesce(own, latest) as close, coalesce(coalesce(own, latest) < timestamp '1995-06-16', false) and not coalesce(case when game then o_orderdate + interval 90 day end >= timestamp '1995-06-17', false) as stale from e""",
)
def event_closes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_shipdate").alias("closes"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    rows = rows.withColumn("close", snapshots.event_close(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")), F.col("closes")))
    start = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate") + F.expr("interval 90 day"))
    return rows.select(F.col("o_orderkey").alias("event"), "close", snapshots.is_stale(F.col("close"), start, F.lit("1995-06-17").cast("timestamp")).alias("stale"))


@query(
    "coverage_report",
    """with i as (select distinct o_custkey as id from orders), t as (select c_custkey as id, case when c_custkey % 2 = 0 then timestamp '1996-01-01' when c_custkey % 3 = 0 then timestamp '1994-01-01' end as created from customer),
b as (select i.id as mine, t.id as own, created from i full join t on i.id = t.id)
select count(own) as truth, count(mine) as ingested, count(*) filter (mine is null and not coalesce(created > timestamp '1995-06-17', false)) as gap, count(*) filter (mine is null and coalesce(created > timestamp '1995-06-17', false)) as drift,
  count(*) filter (own is null) as closed_since, round(100 * cast(count(*) filter (own is not null and mine is not null) as double) / count(own), 4) as pct, count(*) filter (mine is null and not coalesce(created > timestamp '1995-06-17', false)) = 0 as clean from b""",
)
def coverage_report(spark, sf_dir):
    k = F.col("c_custkey")
    created = F.when(k % 2 == 0, F.lit("1996-01-01")).when(k % 3 == 0, F.lit("1994-01-01")).cast("timestamp")
    truth = table(spark, sf_dir, "customer").select(k.alias("id"), created.alias("created"))
    return history.coverage_report(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct(), truth, "1995-06-17")


@query(
    "verdict_digest",
    """with v as (select user_id as a, event_type as b, ts, event_id as line_no, value > 10 as same, value > 5 as same_event, event_type as reason from events),
l as (select *, row_number() over (partition by a, b order by ts desc, line_no desc) as rn, count(*) filter (not same) over (partition by a, b) as flags, max(ts) over () as last from v)
select a, b, ts, same, same_event, reason, flags, case when epoch_us(timestamp '2024-01-20') - epoch_us(ts) > 72 * 3600000000 then 'stale' when same then 'agreed' when not same_event then 'wrong event' else 'wrong contract' end as mode from l where rn = 1""",
)
def verdict_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("a"), F.col("event_type").alias("b"), "ts", F.col("event_id").alias("line_no"), (F.col("value") > 10).alias("same"), (F.col("value") > 5).alias("same_event"), F.col("event_type").alias("reason")
    )
    return reviews.verdict_digest(rows, "2024-01-20", 72)


@query(
    "round_robin",
    "select p_partkey, p_brand from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as turn from part) order by turn, p_brand limit 30 offset 7",
)
def round_robin(spark, sf_dir):
    return reviews.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 30, 7)
