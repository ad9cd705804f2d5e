"""Title queries: titles made of the words in orders, customer, lineitem and part, their features and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinbook.checkpoints import cut
from twinbook.functions import features
from twinbook.operators import conflicts
from twinbook.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Ids of a range, whose titles meet in one task; titles of a task, about.
RANGE, READ = 1024, 1 << 16
#: Ways of asking, in the order of l_linenumber + l_orderkey: every line of lineitem is one title.
#: {name}: a part's name, {price}: its price in whole dollars, {n}: its size, {m}: the month's name, {d}: the day, {y}: the year, {q}: the quantity.
TEMPLATES = (
    "Will {name} be above ${price} by {m} {d}, {y}?",
    "{name} vs {brand}: who will win the match in week {n}?",
    "Will {name} win the {y} championship in the {n}th round?",
    "Will {brand} score {q}+ points in the 1st half?",
    "How many rate cuts: {n} bps cut by the Fed in Q{k} {y}?",
    "Will the Republican nominee win the governor race in Ohio by {n}% of the vote?",
    "Best Picture or MVP: will {name} not be nominated for the {y} Oscars?",
    "Will {name} fall below ${price} or hit {q} million before {m}?",
    "Will {brand} finish {n}th place or qualify for the Champions League group stage?",
    "Will Senate control go to the Democrats, TX-{n} seat, first round?",
    "Will {name} IPO or be acquired by Apple for ${n} billion?",
    "Will {q} or more tariffs be signed this week, {m} {d}-{n}?",
)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title): one title per line of lineitem."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size", "p_retailprice")
    fields = {
        "name": F.initcap("p_name"), "brand": F.col("p_brand"), "price": F.floor("p_retailprice").cast("string"), "n": F.col("p_size").cast("string"),
        "m": F.date_format("l_shipdate", "MMMM"), "d": F.dayofmonth("l_shipdate").cast("string"), "y": F.year("l_shipdate").cast("string"),
        "q": F.col("l_quantity").cast("int").cast("string"), "k": F.quarter("l_shipdate").cast("string"),
    }

    def fill(template: str):
        parts = [p for piece in template.split("{") for p in piece.split("}")]
        return F.concat(*(fields[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))

    form = F.element_at(F.array(*(fill(t) for t in TEMPLATES)), (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(TEMPLATES))) + 1).cast("int"))
    return lines.join(part, "l_partkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), form.alias("title"))


def _sql_fill(template: str) -> str:
    fields = {
        "name": "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')", "brand": "p_brand",
        "price": "cast(cast(floor(p_retailprice) as bigint) as varchar)", "n": "cast(p_size as varchar)", "m": "monthname(l_shipdate)", "d": "cast(day(l_shipdate) as varchar)",
        "y": "cast(year(l_shipdate) as varchar)", "q": "cast(cast(l_quantity as int) as varchar)", "k": "cast(quarter(l_shipdate) as varchar)",
    }
    parts = [p for piece in template.split("{") for p in piece.split("}")]
    return " || ".join(fields[p] if k % 2 else _text(p) for k, p in enumerate(parts))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TITLES = (
    "titles as (select l_orderkey * 10 + l_linenumber as id, case (l_orderkey + l_linenumber) % "
    + f"{len(TEMPLATES)} " + " ".join(f"when {k} then {_sql_fill(t)}" for k, t in enumerate(TEMPLATES)) + " end as title from lineitem join part on l_partkey = p_partkey)"
)


def feature_sql(feature: features.Feature) -> str:
    """A feature as DuckDB SQL over ``title``."""
    text = "coalesce(title, '')" if feature.raw else "lower(strip_accents(coalesce(title, '')))"
    has = lambda p: f"regexp_matches({text}, {_text(p)})"
    there = has(feature.context) if feature.context else "true"
    if feature.kind == "flag":
        return f"({has(feature.patterns)} and {there})"
    if feature.kind == "case":
        return "case " + " ".join(f"when {has(p)} and {there} then {_text(n)}" for n, p in feature.patterns.items()) + " end"
    if feature.kind == "groups":
        out = ", ".join(f"regexp_extract({text}, {_text(feature.patterns)}, {k + 1})" for k in range(features.n_groups(feature.patterns)))
        return f"case when {has(feature.patterns)} and {there} then [{out}] end"
    if feature.kind == "set":
        lists = [f"regexp_extract_all({text}, {_text(p)}, 1)" for p in feature.patterns]
        out = lists[0] if len(lists) == 1 else f"flatten([{', '.join(lists)}])"
        out = f"list_sort(list_distinct({out}))"
    else:
        out = "list_sort(list_filter([" + ", ".join(f"case when {has(p)} then {_text(n)} end" for n, p in feature.patterns.items()) + "], lambda x: x is not null))"
    return f"case when {there} then {out} else [] end" if feature.context else out


def _plain(feature: features.Feature, value, join):
    return value if feature.kind in ("flag", "case") else join(value)


def _family(name: str):
    table_ = features.FAMILIES[name]

    def run(spark, sf_dir):
        rows = titles(spark, sf_dir).withColumn("low", features.ascii_lower(F.col("title")))
        rows = rows.select("id", features.read(table_, F.col("title"), F.col("low")).alias("spec"))
        return rows.select("id", *(_plain(f, F.col("spec")[n], lambda c: F.array_join(c, "|")).alias(n) for n, f in table_.items()))

    run.__name__ = run.__qualname__ = f"title_{name}"
    run.__doc__ = f"The features of family {name} of every title."
    QUERIES[f"title_{name}"] = run
    columns = ", ".join(f"{_plain(f, feature_sql(f), lambda c: f'array_to_string({c}, chr(124))')} as \"{n}\"" for n, f in table_.items())
    ORACLE_SQL[f"title_{name}"] = f"with {_TITLES} select id, {columns} from titles"


for _name in features.FAMILIES:
    _family(_name)


def _fires_sql(rule: conflicts.Conflict) -> str:
    kind = {n: f.kind for family in features.FAMILIES.values() for n, f in family.items()}

    def has(side: str, name: str) -> str:
        x = f'{side}."{name}"'
        return x if kind[name] == "flag" else f"len({x}) > 0" if kind[name] in ("set", "labels") else f"{x} is not null"

    f, o = rule.feature, rule.other
    x, y = f'a."{f}"', f'b."{f}"'
    if rule.kind == "only":
        return f"({has('a', f)}) <> ({has('b', f)})"
    if rule.kind == "opposed":
        one = lambda s, t: f"({has(s, f)} and not ({has(s, o)}) and {has(t, o)} and not ({has(t, f)}))"
        return f"{one('a', 'b')} or {one('b', 'a')}"
    if rule.kind == "differ":
        return f"coalesce({x} <> {y}, false)"
    if rule.kind == "single":
        return f"len({x}) = 1 and len({y}) = 1 and {x}[1] <> {y}[1]"
    apart = f"len({x}) > 0 and len({y}) > 0 and not list_has_any({x}, {y})"
    if rule.kind == "nested":
        return f"{apart} or (len({x}) > 0 and len({y}) > 0 and not list_has_all({x}, {y}) and not list_has_all({y}, {x}))"
    return apart


_USED = sorted({n for r in conflicts.CONFLICTS for n in (r.feature, r.other) if n})
_ALL = {n: f for family in features.FAMILIES.values() for n, f in family.items()}


def title_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title against the next of its order: which rules part them."""
    # Titles are dealt by ranges of ids and meet where they lie, before they are read; a range's first goes to the range before it too.
    rows, block = titles(spark, sf_dir).where("id is not null"), F.floor(F.col("id") / RANGE)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // READ)
    rows = rows.withColumn("block", F.explode(F.when(F.col("id") % RANGE == 0, F.array(block, block - 1)).otherwise(F.array(block)))).repartition(parts, "block")
    following = F.collect_list(F.struct("title")).over(Window.partitionBy("block").orderBy("id").rangeBetween(1, 1))
    pairs = rows.select(F.col("id").alias("id_a"), F.col("title").alias("a"), following.alias("b")).select("id_a", "a", F.explode("b").alias("b"))
    spec = features.read_pair({n: _ALL[n] for n in _USED}, F.col("a"), F.col("b.title"))
    pairs = pairs.select("id_a", (F.col("id_a") + 1).alias("id_b"), spec.alias("spec")).select("id_a", "id_b", F.col("spec.a").alias("spec_a"), F.col("spec.b").alias("spec_b"))
    return conflicts.conflicts(pairs).select("id_a", "id_b", F.array_join("reasons", ",").alias("reasons"), "reason")


QUERIES["title_conflicts"] = title_conflicts
ORACLE_SQL["title_conflicts"] = (
    f"with {_TITLES}, s as (select id, " + ", ".join(f'{feature_sql(_ALL[n])} as "{n}"' for n in _USED) + " from titles), "
    + "p as (select a.id as id_a, b.id as id_b, list_filter([" + ", ".join(f"case when {_fires_sql(r)} then {_text(r.name)} end" for r in conflicts.CONFLICTS)
    + "], lambda x: x is not null) as reasons from s a join s b on b.id = a.id + 1) select id_a, id_b, array_to_string(reasons, ',') as reasons, reasons[1] as reason from p"
)


def title_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-sided bounds of the titles, and whether those of neighbours are equal."""
    # The titles are read once, for both sides of the join.
    rows = cut(titles(spark, sf_dir).select("id", features.threshold(F.col("title")).alias("t")).where("t is not null"))
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("t").alias("u")), "id", "left")
    return both.select("id", "t.up", "t.value", "t.unit", features.threshold_equal(F.col("t"), F.col("u")).alias("same_as_next"))


QUERIES["title_thresholds"] = title_thresholds
