"""Ingestion accounting over part and supplier, log states over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.operators import ingest, log_state
from twinbook.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_BEGAN, _HORIZON, _EVENTS = "2026-01-10", "2026-01-26", 14
# Read by Spark and DuckDB alike. Events are brands, which close on a day of their number; suppliers are what a sweep finds.
_MARKETS = """concat('p', p_partkey) as market_id, p_brand as event_id, case p_partkey % 10 when 3 then 'closed' when 4 then null else 'active' end as status,
  case p_partkey % 8 when 1 then concat('yes ', p_name, ', no other') when 2 then concat(p_name, ' win, win or win') else p_name end as title,
  case when p_brand like '%3' then 'mve-1' else 'kx' end as ticker, case when p_brand like '%4' then 'Box score' else p_type end as event_title,
  cast(concat('2026-01-', lpad(cast(5 + cast(replace(p_brand, 'Brand#', '') as int) as varchar(9)), 2, '0')) as timestamp) as event_close, case when p_brand like '%1' then 'Sports' else 'Other' end as category"""
_SWEEP = """case when s_suppkey % 3 = 0 then concat('p', s_suppkey) else concat('s', s_suppkey) end as market_id, case when s_suppkey % 5 = 0 then 'Brand#7' else concat('E', s_nationkey) end as event_id, case when s_suppkey % 7 = 0 then 'closed' else 'active' end as status,
  s_name as title, 'kx' as ticker, 'swept' as event_title, cast('2026-01-12' as timestamp) as event_close, 'Other' as category"""
_TEXTS = """case event_type when 'click' then concat('scan done: ', cast(50 + event_id % 400 as varchar(9)), ' pairs')
  when 'purchase' then case when event_id % 9 = 0 then concat('EMAIL FAILED: code ', cast(event_id % 100 as varchar(9))) else concat('EMAILED ', cast(event_id % 1000 as varchar(9)), ' signals') end
  when 'view' then case when event_id % 5 = 0 then 'AI verify: key ABSENT' else concat('AI verify: ', cast(event_id % 4 as varchar(9)), ' checked, 0 confirmed, ', cast(event_id % 2 as varchar(9)), ' flagged') end
  when 'signup' then concat('[coverage] v', cast(event_id % 2 as varchar(9)), ': 1,200/1,300 (', case when event_id % 3 = 0 then '100.0%' else '92.3%' end, ') sweep=', case when event_id % 4 = 0 then 'partial' else 'fresh' end)
  else case when value > 20 then concat('CYCLE ERROR: ', cast(event_id as varchar(9))) else 'nothing to say' end end"""


def ingest_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the counts of an ingestion whose snapshots are read whole, and whether they add up."""
    for name in ("part", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"ingest_{name}")
    markets, sweep = spark.sql(f"select {_MARKETS} from ingest_part"), spark.sql(f"select {_SWEEP} from ingest_supplier")
    snapshots, counts = ingest.ingest(markets, _BEGAN, sweep, category="other", horizon=_HORIZON, most_events=_EVENTS)
    snapshots.write.format("noop").mode("overwrite").save()
    got = counts.get
    names = ["catalog", "orphan_scanned", "ingested", "held_out", *(f"excluded_{r}" for r in ingest.REASONS)]
    return spark.createDataFrame([(*(got[n] for n in names), ingest.balanced(got))], ", ".join(f"{n} long" for n in names) + ", balanced boolean")


def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("log_events")
    lines = spark.sql(f"select user_id % 7 as log, event_id as line_no, {_TEXTS} as text from log_events")
    return log_state.overall_ok(log_state.log_state(lines))


QUERIES |= {"ingest_accounting": ingest_accounting, "log_states": log_states}
ORACLE_SQL["ingest_accounting"] = f"""
with m as (select {_MARKETS}, false as orphan, false as known from part),
s as (select *, true as orphan, market_id in (select market_id from m) or event_id in (select event_id from m) as known from (select {_SWEEP} from supplier)),
r as (select *, case when event_close < timestamp '{_BEGAN}' then 'event_closed' when lower(category) <> 'other' then 'category' when event_close > timestamp '{_HORIZON}' then 'horizon' end as reason from (from m union all from s)),
firsts as (select event_id from r where reason is null group by event_id order by min(event_close), event_id limit {_EVENTS}),
c as (select *, case when known then 'orphan_known' when reason is not null then reason when event_id not in (select event_id from firsts) then 'event_cap' when status is distinct from 'active' then 'status' end as excluded from r)
select count(*) filter (not orphan) as catalog, count(*) filter (orphan) as orphan_scanned, count(*) filter (excluded is null) as ingested,
  count(*) filter (excluded is null and (ticker like 'mve%' or event_title = 'Box score' or title like 'yes %, no %' or title like '%win, win or win%')) as held_out,
  {", ".join(f"count(*) filter (excluded = '{r}') as excluded_{r}" for r in ingest.REASONS)}, true as balanced from c"""
_since = "max(line_no) filter (mark = '{0}')"
ORACLE_SQL["log_states"] = f"""
with l as (select user_id % 7 as log, event_id as line_no, {_TEXTS} as text from events),
m as (select *, case when contains(text, 'scan done') then 'scan' when contains(text, 'EMAIL FAILED') then 'failed' when contains(text, 'EMAILED') then 'sent' when contains(text, 'AI verify:') then 'verified' when contains(text, 'CYCLE ERROR') then 'error' end as mark,
  trim(regexp_extract(text, '(?:scan done|EMAIL FAILED|EMAILED|AI verify:|CYCLE ERROR):?(.*)$', 1)) as said, case when contains(text, 'scan done') then try_cast(regexp_extract(text, '(\\d+) pairs', 1) as bigint) end as pairs from l),
g as (select log, max(line_no) as last_line, {", ".join(f"{_since.format(n)} as {n}_at, arg_max(said, line_no) filter (mark = '{n}') as {n}" for n, _ in log_state.MARKS)}, arg_max(pairs, line_no) filter (pairs is not null) as last_pairs, median(pairs) as median_pairs, count(pairs) as n_scans from m group by log),
v as (select log, regexp_extract(text, '\\] (\\w+):', 1) as venue, arg_max(text, line_no) as text from l where text like '[coverage]%' group by 1, 2),
d as (select log, bool_or(text like '%partial%' or text not like '%100.0%') as degraded from v group by log),
b as (select m.log, count(*) as since from m join g on m.log = g.log and m.mark = 'scan' and line_no > sent_at group by 1),
f as (
  select g.log, scan as last_scan, last_pairs, median_pairs, n_scans >= 3 and median_pairs >= 100 and last_pairs < 0.5 * median_pairs as pairs_low, sent as last_sent, case when sent_at is not null then coalesce(since, 0) end as scans_since_sent, verified as last_verified,
    coalesce(contains(verified, 'ABSENT'), false) as key_absent, coalesce(regexp_matches(verified, '^[1-9]\\d* checked, 0 confirmed, 0 flagged'), false) as verifier_failing, sent is not null and verified is null as sent_unverified,
    case when error_at > last_line - 200 then error end as recent_error, case when failed_at > last_line - 200 then failed end as recent_failure, coalesce(degraded, false) as coverage_degraded
  from g left join b using (log) left join d using (log))
select *, last_scan is not null and not (key_absent or verifier_failing or sent_unverified or pairs_low or coverage_degraded or recent_error is not null or recent_failure is not null) as ok from f"""
