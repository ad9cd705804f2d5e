"""Recall and order statistics: two catalogs made of part, price gaps of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.functions.text import tokens
from twinbook.operators import coverage
from twinbook.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Both catalogs in words that Spark and DuckDB read alike: the same markets, worded apart by the part's key.
_A = """p_partkey as id, concat(p_name, case when p_partkey % 4 = 0 then ' (D)' else '' end) as label,
  concat('Who wins the ', p_type, ' prize of ', p_brand, case when p_partkey % 9 = 0 then ' 2026' when p_partkey % 9 = 1 then ' no 7' else '' end) as event,
  concat('Will ', p_name, ' part ', p_partkey, ' ever be sold in ', p_brand, ' for more') as title"""
_B = """p_partkey as id, p_name as label,
  case when p_partkey % 6 = 0 then concat('will ', p_name, ' PART ', p_partkey, ' be sold in ', p_brand, case when p_partkey % 12 = 0 then ' for more?' else ' for nothing at all?' end)
    when p_partkey % 7 = 0 then concat(p_type, ' vs. ', p_brand) else concat(p_type, ' prize of ', p_brand, ': winner', case when p_partkey % 9 = 0 then ' 2027' else '' end) end as event,
  case when p_partkey % 6 = 0 then concat('Will ', p_name, ' part ', p_partkey, ' be sold in ', p_brand, case when p_partkey % 12 = 0 then ' for more?' else ' for nothing at all?' end)
    else concat('Will ', p_name, ' win it?') end as question"""
_FOUND = 0.6


def catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("oracle_part")
    return spark.sql(f"select {_A} from oracle_part"), spark.sql(f"select {_B} from oracle_part")


def text_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.text_oracle(*catalogs(spark, sf_dir))


def text_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a similarity join of the event's and the label's words finds of the oracle's pairs; it endorses equal labels."""
    a, b = catalogs(spark, sf_dir)
    sets = lambda rows: rows.select("id", tokens(F.concat_ws(" ", "event", "label")).alias("toks"), "label")
    return coverage.similarity_recall(coverage.text_oracle(a, b), sets(a), sets(b), _FOUND)


def price_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("l_extendedprice") / F.col("l_quantity") / 2000 - F.col("l_discount"))
    return coverage.gap_summary(table(spark, sf_dir, "lineitem").select(F.round(gap, 3).alias("gap")))


_words = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> '' and not list_contains([{', '.join(repr(w) for w in coverage.STOP)}], w)))"
_numbers = lambda t: f"list_sort(list_distinct(list_filter(regexp_extract_all({t}, '\\d+'), lambda n: not list_contains([{', '.join(repr(y) for y in coverage.YEARS)}], n))))"
_key = lambda t: f"regexp_replace(regexp_replace(lower({t}), '[(][^)]*[)]', '', 'g'), '[^a-z0-9]+', '', 'g')"
_jaccard = lambda x, y: f"(len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))))"
_TRUTH = f"""a as (select {_A} from part), b as (select {_B} from part),
ra as (select *, {_key("label")} as key, {_words("event")} as we, {_numbers("event")} as ne, {_words("title")} as wt from a),
rb as (select *, {_key("label")} as key, {_words("event")} as we, {_numbers("event")} as ne, {_words("question")} as wq from b),
labels as (
  select ra.id as id_a, rb.id as id_b from ra join rb on ra.key = rb.key and ra.ne = rb.ne and length(ra.key) >= 4 and {_jaccard("ra.we", "rb.we")} >= 0.5
  where not regexp_matches(lower(rb.event), '\\bvs\\.?\\b') and not regexp_matches(lower(ra.event), '\\bvs\\.?\\b')),
df as (select w, count(*) as n from ra, unnest(wt) as x(w) group by w),
rare as (
  select id, wq, list(w order by coalesce(n, 0), w)[1:2] as two from (select rb.id, wq, w, n from rb, unnest(wq) as x(w) left join df using (w) where lower(trim(rb.event)) = lower(trim(rb.question)) and len(wq) >= 4) group by id, wq),
asked as (select ra.id as id_a, rare.id as id_b from rare join ra on list_contains(ra.wt, two[1]) and list_contains(ra.wt, two[2]) and {_jaccard("wt", "wq")} >= 0.7),
truth as (select min(id_a) as id_a, id_b from labels group by id_b having count(*) = 1 union select min(id_a), id_b from asked group by id_b having count(*) = 1)"""
QUERIES |= {"text_oracle": text_oracle, "text_recall": text_recall, "price_gaps": price_gaps}
ORACLE_SQL["text_oracle"] = f"with {_TRUTH} select * from truth"
ORACLE_SQL["text_recall"] = f"""with {_TRUTH},
sa as (select id, label, list_distinct(regexp_extract_all(lower(event || ' ' || label), '[a-z0-9]+')) as t from a), sb as (select id, label, list_distinct(regexp_extract_all(lower(event || ' ' || label), '[a-z0-9]+')) as t from b),
found as (select sa.id as id_a, sb.id as id_b, sa.label = sb.label as endorsed from sa join sb on {_jaccard("sa.t", "sb.t")} >= {_FOUND}),
hits as (select endorsed from truth join found using (id_a, id_b))
select (select count(*) from found) as pairs, (select count(*) from found where endorsed) as endorsed, (select count(*) from truth) as oracle, round((select count(*) from hits) / greatest(1, (select count(*) from truth)), 4) as recall_matched,
  round((select count(*) from hits where endorsed) / greatest(1, (select count(*) from truth)), 4) as recall_endorsed, (select count(*) from hits where not endorsed) as rejected"""
ORACLE_SQL["price_gaps"] = """with g as (select round(abs(l_extendedprice / l_quantity / 2000 - l_discount), 3) as gap from lineitem)
select count(gap) as n, round(median(gap), 4) as median, round(list_sort(list(gap))[(0.9 * count(gap))::int + case when (0.9 * count(gap))::int > 0.9 * count(gap) then 0 else 1 end], 4) as p90, count(*) filter (gap > 0.3) as over from g"""
