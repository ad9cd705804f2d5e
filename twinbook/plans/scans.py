"""Scan queries: pairs from orders and lineitem, history from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.operators import history, signals, summary
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


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per line item: net on a grid of 0.01, null for every 11th; depth profit for those with a size above 20."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 != 0, (2 * cents("l_discount") - cents("l_tax")) / 100).alias("net"),
        ((cents("l_discount") - cents("l_tax")) / 100).alias("net_flat"), F.when(F.col("l_quantity") > 20, cents("l_discount") * F.col("l_quantity") / 100).alias("exec_profit"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return lines.join(orders, "o_orderkey")


_PAIRS = """pairs as (
  select o_orderkey, l_linenumber, o_orderpriority, o_orderstatus, o_orderdate,
    case when (l_orderkey + l_linenumber) % 11 <> 0 then cast(2 * cast(round(l_discount * 100) as int) - cast(round(l_tax * 100) as int) as double) / 100 end as net,
    cast(cast(round(l_discount * 100) as int) - cast(round(l_tax * 100) as int) as double) / 100 as net_flat,
    case when l_quantity > 20 then cast(round(l_discount * 100) as int) * l_quantity / 100 end as exec_profit
  from lineitem join orders on l_orderkey = o_orderkey)"""
_COUNTS = """count(*) as total, count(net) as priced, count(*) filter (net > 0) as positive, count(*) filter (net_flat > 0) as positive_flat,
  count(*) filter (net > 0.01) as over_1, count(*) filter (net > 0.03) as over_3, count(*) filter (net > 0.05) as over_5, count(*) filter (net > 0.10) as over_10"""


@query(
    "summary_funnel",
    f"""with {_PAIRS}
select 'all' as population, {_COUNTS} from pairs
union all select 'endorsed', {_COUNTS} from pairs where o_orderstatus <> 'F'
union all select 'gated', {_COUNTS} from pairs where o_orderstatus = 'O'""",
)
def summary_funnel(spark, sf_dir):
    return summary.funnel(pairs(spark, sf_dir), {"all": F.lit(True), "endorsed": F.col("o_orderstatus") != "F", "gated": F.col("o_orderstatus") == "O"})


@query(
    "summary_groups",
    f"""with {_PAIRS}
select o_orderpriority as key, count(*) as pairs, count(net) as priced, count(*) filter (net > 0) as positive, count(*) filter (net > 0 and net <= 0.10) as positive_plausible,
  max(net) as best_edge, coalesce(cast(sum(cast(round(exec_profit * 10000) as bigint)) filter (net > 0 and net <= 0.10) as double) / 10000, 0) as exec_profit
from pairs group by 1""",
)
def summary_groups(spark, sf_dir):
    return summary.group_stats(pairs(spark, sf_dir), F.col("o_orderpriority"))


@query(
    "summary_plausibility",
    f"""with {_PAIRS}
select case when net <= 0.10 then 'plausible' else 'implausible' end as band, count(*) as pairs, count(exec_profit) as with_depth,
  coalesce(cast(sum(cast(round(exec_profit * 10000) as bigint)) as double) / 10000, 0) as profit
from pairs where net > 0 group by 1""",
)
def summary_plausibility(spark, sf_dir):
    return summary.plausibility(pairs(spark, sf_dir))


@query("summary_top", f"with {_PAIRS} select o_orderkey, l_linenumber, net from pairs order by net desc nulls last, o_orderkey, l_linenumber limit 15")
def summary_top(spark, sf_dir):
    return summary.top_rows(pairs(spark, sf_dir).select("o_orderkey", "l_linenumber", "net"), [F.desc_nulls_last("net"), F.col("o_orderkey"), F.col("l_linenumber")])


@query(
    "coverage_ledger",
    """with m as (select p_type as family, p_size = 7 as excluded, p_partkey % 4 = 0 and p_type <> 'X' and p_size <> 7 as matched from part),
c as (select family, count(*) as total, count(*) filter (excluded) as held_out, count(*) filter (matched) as matched from m group by family)
select family, total, held_out, matched, case when matched = 0 then 'never' when matched < total - held_out then 'partly' else 'fully' end as state from c""",
)
def coverage_ledger(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return summary.coverage_ledger(
        part.select(F.col("p_type").alias("family"), (F.col("p_size") == 7).alias("excluded"), ((F.col("p_partkey") % 4 == 0) & (F.col("p_type") != "X") & (F.col("p_size") != 7)).alias("matched"))
    )


@query(
    "event_cap",
    """with e as (select o_orderkey as event, o_orderdate, o_orderpriority = '1-URGENT' and o_orderkey % 50 = 0 as always from orders),
first as (select * from e order by o_orderdate, event limit 100)
select event from first union select event from e where always""",
)
def event_cap(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), "o_orderdate", ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 50 == 0)).alias("always"))
    return summary.event_cap(events, [F.col("o_orderdate"), F.col("event")], 100, F.col("always")).select("event")


@query(
    "latest_event",
    "select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1",
)
def latest_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return history.latest(events, ["user_id", "event_type"], "ts", "event_id")


@query(
    "dedupe_ranked",
    "select pair_key, rank, value from (select user_id as pair_key, event_id as rank, value, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1",
)
def dedupe_ranked(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_key"), F.col("event_id").alias("rank"), "value")
    return history.dedupe_ranked(events, "pair_key", "rank")


@query(
    "compare_scans",
    """with b as (select l_partkey as key, max(cast(round(l_discount * 100) as int)) / cast(100 as double) as net from lineitem where l_shipdate < timestamp '1995-06-17' group by 1),
a as (select l_partkey as key, max(cast(round(l_discount * 100) as int)) / cast(100 as double) as net from lineitem where l_shipdate >= timestamp '1995-06-17' group by 1),
j as (select coalesce(b.key, a.key) as key, case when b.key is null then 'added' when a.key is null then 'removed' when round(a.net - b.net, 6) <> 0 then 'changed' end as change,
  b.net as net_before, a.net as net_after, round(a.net - b.net, 6) as d from b full join a on a.key = b.key)
select key, change, net_before, net_after, case when change = 'changed' then d end as delta from j where change is not null""",
)
def compare_scans(spark, sf_dir):
    """The scans are the lines shipped before a day and those shipped from it on: every line is in one."""
    lines, day = table(spark, sf_dir, "lineitem"), F.to_timestamp(F.lit("1995-06-17"))
    scan = lambda of: lines.where(of).groupBy(F.col("l_partkey").alias("key")).agg((F.max(F.round(F.col("l_discount") * 100).cast("int")) / 100).alias("net"))
    return history.compare_scans(scan(F.col("l_shipdate") < day), scan(F.col("l_shipdate") >= day))


@query(
    "keep_newest",
    "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 2",
)
def keep_newest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.keep_newest(orders, ["o_custkey"], F.desc(F.struct("o_orderdate", "o_orderkey")), 2)


@query(
    "coverage_diff",
    """with ids as (select l_partkey * 1000000 + l_suppkey as id, l_shipdate < timestamp '1995-06-17' as early from lineitem),
seen as (select distinct id from ids where early), truth as (select distinct id from ids where not early)
select id, 'gap' as state from truth where id not in (select id from seen) union all select id, 'closed_since' from seen where id not in (select id from truth)""",
)
def coverage_diff(spark, sf_dir):
    """What was ingested are the offers (part and supplier) of lines shipped before a day; what there is, those of the others."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id"), (F.col("l_shipdate") < F.to_timestamp(F.lit("1995-06-17"))).alias("early"))
    return history.coverage_diff(lines.where("early").select("id"), lines.where("not early").select("id")).distinct()


@query(
    "realerts",
    """with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events),
s as (select user_id as key, value as net, ts from e where rn = 1), o as (select user_id as key, value as net, ts from e where rn = 3),
j as (select s.*, case when o.key is null then 'new' when s.net >= o.net + 0.005 - 1e-12 then 'improved' when epoch_us(s.ts) - epoch_us(o.ts) >= 21600000000 then 'due' end as reason
  from s left join o using (key))
select * from j where reason is not null""",
)
def realerts(spark, sf_dir):
    place = F.expr("row_number() over (partition by user_id order by ts desc, event_id desc)")
    rows = table(spark, sf_dir, "events").withColumn("rn", place).select(F.col("user_id").alias("key"), F.col("value").alias("net"), "ts", "rn")
    return history.realerts(rows.where("rn = 1").drop("rn"), rows.where("rn = 3").drop("rn"), 6, 0.005)


@query(
    "compute_signals",
    f"""with {_PAIRS}, c as (
  select o_orderkey * 10 + l_linenumber as pair, 0 as place, 'a_yes' as direction, net from pairs where o_orderstatus <> 'P'
  union all select o_orderkey * 10 + l_linenumber, 1, 'b_yes', net_flat from pairs where o_orderstatus <> 'P'),
r as (select *, row_number() over (partition by pair order by net desc, place) as rn from c where net is not null)
select pair, direction, net from r where rn = 1 and net between 0.02 and 0.15""",
)
def compute_signals(spark, sf_dir):
    one = lambda d, n: F.struct(F.lit(d).alias("direction"), F.col(n).alias("net"), F.col("exec_profit").alias("exec_net"))
    rows = pairs(spark, sf_dir).select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), F.lit(True).alias("endorsed"), (F.col("o_orderstatus") == "P").alias("risk"),
        F.array(one("a_yes", "net"), one("b_yes", "net_flat")).alias("candidates"),
    )
    return signals.compute_signals(rows, 0.02, 0.15).select("pair", "direction", "net")


@query(
    "ranked_signals",
    f"""with {_PAIRS}, s as (select o_orderkey * 10 + l_linenumber as key, net, cast(o_orderdate as date) as close_a, cast(o_orderdate as date) + 30 as close_b from pairs where net > 0),
d as (select *, date_diff('day', date '1995-06-17', greatest(close_a, close_b)) as raw from s),
e as (select key, net, case when raw >= -1 then greatest(raw, 1) end as days from d),
f as (select *, case when days is null then net else net * 365 / greatest(days, 1) end as annualised from e)
select key, net, days, annualised from f order by annualised desc nulls last, net desc nulls last, key limit 50""",
)
def ranked_signals(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    rows = pairs(spark, sf_dir).where("net > 0").select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "net", day.alias("close_a"), F.date_add(day, 30).alias("close_b"))
    return signals.ranked(rows, "1995-06-17", 50).select("key", "net", "days", "annualised")


@query(
    "signal_digest",
    "select user_id as key, count(*) as signals, max(value) as best, arg_max(value, (ts, event_id)) as latest, max(ts) as latest_ts from events group by user_id",
)
def signal_digest(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("value").alias("net"), "ts", F.col("event_id").alias("line_no"))
    return signals.signal_digest(log)
