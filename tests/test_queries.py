"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import random
import re
from datetime import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from .conftest import DATA
from twinbook.functions import features
from twinbook.plans import registry

SF = f"{DATA}/sf0.001"


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x):.6f}"
        return str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got)


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def tokens(t):
    return set(re.findall("[a-z0-9]+", (t or "").lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def greedy(edges):
    """Pairs by score descending, then ids, each end once."""
    kept, ends = [], set()
    for score, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if (0, a) not in ends and (1, b) not in ends:
            ends |= {(0, a), (1, b)}
            kept.append((a, b, score))
    return kept


@pytest.fixture
def long_texts(small_table):
    """Documents that are alike in their first 200 characters and differ after them, or the other way round."""
    rng = random.Random(5)
    words = lambda n, of: " ".join(f"{of}{rng.randrange(40)}" for _ in range(n))
    rows = []
    for i in range(40):
        head, tail = (words(60, "same") if i % 4 < 2 else words(60, f"h{i}x")), words(60, f"t{i // 4}x" if i % 3 else f"u{i}x")
        rows.append((i, None if i == 38 else f"{head} {tail}", "en", i * 7))
    sf = small_table("documents", rows, "doc_id long, text string, lang string, n_chars long")
    return sf, {i: tokens(t) for i, t, _, _ in rows}, {i: n % 100 / 100 for i, _, _, n in rows}


def test_greedy_matching_reads_whole_texts(spark, long_texts):
    sf, toks, _ = long_texts
    edges = [(s, a, b) for a in toks for b in toks if a % 2 == 0 and b % 2 == 1 and (s := jaccard(toks[a], toks[b])) >= 0.45]
    got = [(r["id_a"], r["id_b"], round(r["similarity"], 9)) for r in registry.QUERIES["greedy_matching"](spark, sf).collect()]
    want = [(a, b, round(s, 9)) for a, b, s in greedy(edges)]
    assert want and sorted(got) == sorted(want)


def test_match_groups_reads_whole_texts(spark, long_texts):
    sf, toks, mid = long_texts
    edges = []
    for a in toks:
        for b in toks:
            t = jaccard(toks[a], toks[b])
            p = max(0.0, 1 - abs(mid[a] - mid[b]) / 0.15)
            if a % 2 == 0 and b % 2 == 1 and tokens(f"en-{a // 20}") == tokens(f"en-{b // 20}"):
                score = max(0.7 * t + 0.3, 0.5 * p + 0.3 + 0.2 * t)
                if t >= 0.15 and score >= 0.35:
                    edges.append((score, a, b))
    inside = [e for k in range(2) for e in greedy([e for e in edges if e[1] // 20 == k])]
    got = [(r["id_a"], r["id_b"], round(r["score"], 9)) for r in registry.QUERIES["match_groups"](spark, sf).collect()]
    want = [(a, b, round(s, 9)) for a, b, s in greedy([(s, a, b) for a, b, s in inside])]
    assert want and sorted(got) == sorted(want)


def test_title_conflicts_reads_each_text_once(spark, small_table):
    """Neighbours meet before they are read, in one task for a range of ids: across its ends, with repeated ids and null titles."""
    at = datetime(2026, 3, 1)
    lines = [(101 + i // 10, i % 10, 1 + i % 2, 5.0, at) for i in (*range(8, 18), 14, 30)]
    sf = small_table("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_shipdate timestamp")
    small_table("part", [(1, None, "Brand#1", 3, 900.0), (2, "red box", "Brand#2", 4, 901.0)], "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")
    found = registry.QUERIES["title_conflicts"](spark, sf)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    ids = [r[0] * 10 + r[1] for r in lines]
    assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == sorted((i, j) for i in ids for j in ids if j == i + 1)
    titles = [None, "", "Will X win by 5% in 2026?", "Will X win by 5% in 2026?", "Élan above $5 by March 3, 2027?"]
    rows = spark.createDataFrame(list(zip(titles, titles[1:] + titles[:1], strict=True)), "a string, b string").coalesce(1)
    table = {n: f for family in features.FAMILIES.values() for n, f in family.items()}
    low = lambda c: features.ascii_lower(F.col(c))
    both = rows.select(features.read_pair(table, F.col("a"), F.col("b")).alias("x"), F.struct(features.read(table, F.col("a"), low("a")).alias("a"), features.read(table, F.col("b"), low("b")).alias("b")).alias("y"))
    assert all(r["x"] == r["y"] for r in both.collect())
