"""Matching, review and rule queries: markets from pages, reviews from orders and events, rule texts from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.operators import conflicts, decisions, market_match, reviews, vetoes
from twinbook.plans.titles import _ALL, _USED, _fires_sql, _text, feature_sql
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


def greedy_sql(edges: str, score: str) -> str:
    """CTEs ``ranked``, ``walk`` and ``matched`` (id_a, id_b, score): greedy matching of the CTE ``edges``, one edge after the other."""
    return f"""ranked as (select *, row_number() over (order by {score} desc, id_a, id_b) as k from {edges}),
walk(k, ua, ub, kept) as (select cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]), false
  union all select r.k, case when free then list_append(ua, id_a) else ua end, case when free then list_append(ub, id_b) else ub end, free
  from (select w.ua, w.ub, r.*, not list_contains(w.ua, r.id_a) and not list_contains(w.ub, r.id_b) as free from walk w join ranked r on r.k = w.k + 1) r),
matched as (select r.* from ranked r join walk w on w.k = r.k where w.kept)"""


#: A page's market: its title, for every third page a bound, and the close of the order of its number.
def _markets(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<title>(.*?)</title>", 1)
    bound = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" above $"), (F.floor(F.col("page_id") / 6) % 50 + 1).cast("string"), F.lit(" million"))).otherwise("")
    pages = table(spark, sf_dir, "pages").where(F.col("page_id") % 2 == side)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("page_id")).agg(F.min("o_orderdate").alias("close"))
    return pages.join(orders, "page_id", "left").select(F.col("page_id").alias("id"), F.concat(title, bound).alias("title"), "close")


_MARKETS = (
    "t as (select page_id as id, regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1, 's') || case when page_id % 3 = 0 then ' above $' || cast(floor(page_id / 6) % 50 + 1 as bigint) || ' million' else '' end as title,"
    " case when page_id % 3 = 0 then cast(floor(page_id / 6) % 50 + 1 as bigint) end as bound, close from pages left join (select o_orderkey as page_id, min(o_orderdate) as close from orders group by 1) using (page_id)), s as (select id, bound, close, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) as toks, "
    + ", ".join(f'{feature_sql(_ALL[n])} as "{n}"' for n in _USED) + " from t)"
)
_ANY = " or ".join(f"({_fires_sql(r)})" for r in conflicts.CONFLICTS)


@query(
    "match_markets",
    f"""with recursive {_MARKETS},
forced as (select a.id as id_a, b.id as id_b, cast(len(list_intersect(a.toks, b.toks)) as double) / greatest(1, len(list_distinct(list_concat(a.toks, b.toks)))) as similarity from s a join s b on a.id % 50 = 10 and b.id = a.id + 1),
p as (select a.id as id_a, b.id as id_b, a.bound = b.bound as led, len(list_intersect(a.toks, b.toks)) as n, len(a.toks) as na, len(b.toks) as nb, abs(epoch_us(a.close) - epoch_us(b.close)) / 3.6e9 as hours, ({_ANY}) as parted
  from s a join s b on a.id % 2 = 0 and b.id % 2 = 1),
alike as (select *, cast(n as double) / (na + nb - n) as similarity from p where n > 0 and cast(n as double) / least(na, nb) >= 0.4 and not parted),
edges as (select id_a, id_b, similarity, case when hours is null then similarity else 0.7 * similarity + 0.3 * greatest(0.0, 1 - hours / 9600.0) end as confidence from alike
  where (similarity >= 0.45 or (coalesce(led, false) and similarity >= 0.25)) and (hours is null or hours <= 9600 or similarity >= 0.8)
  and id_a not in (select id_a from forced) and id_b not in (select id_b from forced)),
{greedy_sql("edges", "confidence")}
select id_a, id_b, similarity, confidence, false as via_override, false as inverted from matched union all select id_a, id_b, similarity, 1.0, true, false from forced""",
)
def match_markets(spark, sf_dir):
    overrides = table(spark, sf_dir, "pages").where(F.col("page_id") % 50 == 10).select(F.col("page_id").alias("id_a"), (F.col("page_id") + 1).alias("id_b"))
    return market_match.match_markets(_markets(spark, sf_dir, 0), _markets(spark, sf_dir, 1), overrides=overrides)


@query(
    "current_reviews",
    "select user_id as pair_key, event_id as id, ts as created_at, event_type as verdict from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
)
def current_reviews(spark, sf_dir):
    return reviews.current_reviews(_reviews(spark, sf_dir))


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_key"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("verdict"))


@query(
    "review_queue",
    """with r as (select user_id as pair_key, event_type as verdict, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events),
p as (select c_custkey as pair_key, c_acctbal as net, case when c_custkey % 4 > 0 then c_acctbal - c_custkey % 7 end as exec_net from customer),
q as (select *, row_number() over (order by coalesce(exec_net, net) desc nulls last, net desc nulls last, pair_key) as rank from p)
select q.pair_key, net, exec_net, rank, verdict from q left join r on r.pair_key = q.pair_key and rn = 1 where rank <= 40""",
)
def review_queue(spark, sf_dir):
    exec_net = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") - F.col("c_custkey") % 7)
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_key"), F.col("c_acctbal").alias("net"), exec_net.alias("exec_net"))
    return reviews.review_queue(pairs, _reviews(spark, sf_dir).withColumn("reviewer", F.lit("r")), 40).drop("reviewer")


@query(
    "stale_reviews",
    """with e as (select o_custkey as market_id, o_orderstatus as content_hash from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderstatus desc) as rn from orders) where rn = 1)
select o_orderkey as id, coalesce(o_orderstatus <> a.content_hash, false) or coalesce(case when o_orderkey % 3 > 0 then o_orderstatus end <> b.content_hash, false) as stale
from orders left join e a on a.market_id = o_custkey left join e b on b.market_id = o_custkey + 1""",
)
def stale_reviews(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    evidence = orders.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("venue"), F.col("o_custkey").alias("market_id"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderdate").alias("fetched_at"))
    rows = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("market_a"), (F.col("o_custkey") + 1).alias("market_b"),
        F.col("o_orderstatus").alias("hash_a"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("hash_b"),
    )
    return reviews.with_staleness(rows, evidence).select("id", "stale")


#: Rule texts, by l_suppkey and l_linenumber.
_PHRASES = (
    "In the case of a tie the market resolves to No. It needs the most votes.", "A tie is split evenly between all. Most seats decide.", "It resolves once the bill is signed into law.",
    "It resolves on the official announcement. The value must be between 5 and 9.", "The law takes effect. At least 5 are needed.", "Nothing is said.", "Tied names are ranked in alphabetical order; popular vote. Exactly 3.",
)


def _rules(spark, sf_dir):
    place = (F.col("l_suppkey") * 3 + F.col("l_linenumber")) % len(_PHRASES) + 1
    text = F.element_at(F.array(*(F.lit(p) for p in _PHRASES)), place.cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))


def _policy_sql(policies: dict[str, str]) -> str:
    found = "list_filter([" + ", ".join(f"case when regexp_matches(text, {_text(p)}) then {_text(n)} end" for n, p in policies.items()) + "], lambda x: x is not null)"
    return f"case when len({found}) = 1 then ({found})[1] end"


@query(
    "rule_flags",
    "with t as (select l_orderkey * 10 + l_linenumber as id, case (l_suppkey * 3 + l_linenumber) % " + f"{len(_PHRASES)} " + " ".join(f"when {k} then {_text(p)}" for k, p in enumerate(_PHRASES)) + " end as text from lineitem), "
    + "f as (select id, " + ", ".join(f"{_policy_sql(p)} as {k}" for k, (_, p) in vetoes.POLICIES.items()) + " from t), p as (select a.id as id_a, b.id as id_b, unnest(["
    + ", ".join(f"{{'kind': '{k}', 'severity': '{s}', 'policy_a': a.{k}, 'policy_b': b.{k}}}" for k, (s, _) in vetoes.POLICIES.items())
    + "]) as x from f a join f b on b.id = a.id + 1) select id_a, id_b, x.kind as kind, x.severity as severity, x.policy_a as policy_a, x.policy_b as policy_b from p where x.policy_a <> x.policy_b",
)
def rule_flags(spark, sf_dir):
    """Conflicts of settlement policy between the rule texts of neighbouring lines."""
    rows = _rules(spark, sf_dir).select("id", vetoes.all_policies(F.col("text")).alias("said"))
    a = rows.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"), F.col("said").alias("said_a"))
    pairs = a.join(rows.select(F.col("id").alias("id_b"), F.col("said").alias("said_b")), "id_b")
    flags = pairs.select("id_a", "id_b", F.explode(vetoes.policy_flags(F.col("said_a"), F.col("said_b"))).alias("x"))
    return flags.select("id_a", "id_b", "x.kind", "x.severity", "x.policy_a", "x.policy_b")


#: Pairs of questions with what a reader would decide: (a, b, match, inverted, reason or '' for any ground, risk).
#: ``#`` stands for a number of the row, ``@`` for a name of it.
_PAIRS = (
    ("Will Bitcoin dip below $#,000 at any point in 2026?", "BTC to stay above $#k for all of 2026?", True, True, "complementary bounds", None),
    ("Will @ be banned in the US on Dec 31, 2026?", "@ operating legally in the US at end of 2026?", True, True, "opposite states", None),
    ("Will @ acquired before 2027?", "Will @ IPO before 2027?", False, False, "corporate event", None),
    ("Will @ resign by March 31, 2026?", "Will @ resign in March 2026?", True, False, "", "horizon: only one venue has a deadline"),
    ("Will it close above $#,500 in 2026?", "Will it close above $#,500 in 2027?", False, False, "year", None),
    ("Will it be above $#,500 in March 2026?", "Will it be above $#,900 in March 2026?", False, False, "threshold", None),
    ("Will @ beat Argentina in 2026?", "Will Argentina beat @ in 2026?", False, False, "reversed head-to-head", None),
    ("Fed emergency rate cut in # weeks of 2026?", "Fed rate cut in # weeks of 2026?", False, False, "emergency on one side only", None),
    ("Highest temperature in @ on day # of 2026", "Highest temperature in @ on day # of 2026?", True, False, "", "weather: venues may settle on different stations"),
    ("Will @ and others visit Oslo in 2026?", "Completely unlike words stand here", False, False, "too unlike", None),
)


def _said(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else _text(x)


@query(
    "pair_decisions",
    "with t as (select p_partkey as id, p_partkey % " + f"{len(_PAIRS)} as form from part) select id, "
    + ", ".join(f"case form {' '.join(f'when {i} then {_said(p[k])}' for i, p in enumerate(_PAIRS))} end as {n}" for k, n in ((2, "match"), (3, "inverted"), (4, "reason"), (5, "risk")))
    + " from t",
)
def pair_decisions(spark, sf_dir):
    """A pair of questions for each part; the SQL has what was written by hand beside each form."""
    form = (F.col("p_partkey") % len(_PAIRS)).cast("int")
    name = F.concat(F.lit("B"), F.translate(F.lower(F.conv(F.col("p_partkey") + 100, 10, 26)), "0123456789", "qrstuvwxyz"), F.lit("ia"))
    number = (F.col("p_partkey") % 50 + 30).cast("string")

    def side(k: int):
        text = F.element_at(F.array(*(F.lit(p[k]) for p in _PAIRS)), form + 1)
        return table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("event"), F.replace(F.replace(text, F.lit("@"), name), F.lit("#"), number).alias("question"), F.lit(None).cast("timestamp").alias("close"),
        )

    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id_a"), F.col("p_partkey").alias("id_b"), form.alias("form"))
    found = decisions.decide_pairs(pairs, side(0), side(1))
    d = F.col("decision")
    asked = F.element_at(F.array(*(F.lit(p[4]) for p in _PAIRS)), F.col("form") + 1)
    # An acceptance has several grounds: the one that was written down is picked, if it is among them.
    reason = F.when(F.array_contains(d["reasons"], asked), asked).when(d["match"] & (asked == ""), "").otherwise(F.array_join(d["reasons"], ", "))
    return found.select(F.col("id_a").alias("id"), d["match"].alias("match"), d["inverted"].alias("inverted"), reason.alias("reason"), d["risk"].alias("risk"))
