"""Phrase mining against a count of everything."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twinbook.llm import phrases


def brute(rows, support, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {g: c for g, c in f.items() if c >= support}
    out = []
    for (lang, g), a in f.items():
        inside = [c for (m, h), c in f.items() if m == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if len(g) > 1 and not any(100 * c >= 80 * a for c in inside):
            score, _, l, r = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(*x[:1], i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "𝔘x", "d", "e\x00f", "É", "the", "of", "new", "york"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("?!,", "de"), ("a a a a a a a a a a", "en"), ("x" * 3000 + " y " + "x" * 3000, "en")]
    for _ in range(150):
        words = [rng.choice(["the new york", "of the", *vocabulary, f"r{rng.randrange(300)}"]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(30))]
        rows.append(("".join(words), rng.choice(["en", "en", "en", None, "und", "de"])))
    return rows + rows[-3:]


def test_collocations(spark):
    for seed, support, top, parts in ((1, 4, 2000, 1), (2, 12, 2000, 7), (3, 3, 5, 13)):
        rows = fixture(seed)
        df = spark.createDataFrame([(t, lang, "k", 1, 2) for t, lang in rows], "text string, lang string, phrase string, n int, key int").repartition(parts)
        out = phrases.collocations(df, support=support, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        got, want = sorted(tuple(r) for r in out.collect()), brute(rows, support, top)
        assert want and got == want
    assert phrases.collocations(df.limit(0)).count() == 0


def test_small_pieces_of_work(spark, monkeypatch):
    """Tasks that must flush often, and a filter that lets nearly everything pass, give the same."""
    rows = fixture(4)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    got = sorted(tuple(r) for r in phrases.collocations(df, support=6).collect())
    assert got == brute(rows, 6, 2000)


def test_only_phrases_with_the_support_are_candidates(spark):
    """A shard's favourites are no candidates if all shards together have too few of them."""
    counted = spark.createDataFrame([(0, 1, 10, 3), (1, 1, 10, 1), (0, 1, 20, 3), (1, 1, 20, 3), (0, 1, 30, 2), (1, 1, 30, 2), (2, 1, 30, 2)], "shard int, lang_key long, key long, n long")
    supports = spark.createDataFrame([(s, 1, 3) for s in range(3)], "shard int, lang_key long, least long")
    assert [r.key for r in phrases._candidates(counted, supports, 6).collect()] == [20]


def rows_of_phrases(spark, since):
    """Rows that left Python with a phrase's words in queries after ``since``, and the last query."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    runs = [r.executionId() for r in each(store.executionsList())]
    for run in (r for r in runs if r > since):
        values = store.executionMetrics(run)
        for node in each(store.planGraph(run).allNodes()):
            if node.name() == "MapInArrow" and "phrase#" in node.desc().split("[")[-1]:
                found = [values.get(m.accumulatorId()) for m in each(node.metrics()) if m.name() == "number of output rows"]
                total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return total, max(runs, default=-1)


def test_words_of_a_phrase_come_from_one_task(spark):
    """As many rows leave the last pass as there are candidates and texts, not candidates of each task."""
    text = ". ".join(f"left{i} right{i} end{i}" for i in range(500))
    df = spark.createDataFrame([(text, "en")] * 12, "text string, lang string").repartition(12)
    _, last = rows_of_phrases(spark, float("inf"))
    counts, words = phrases.frequent_phrases(df, support=12)
    assert {r.f for r in counts.collect()} == {12} and counts.count() == 500 * 6
    assert [tuple(r) for r in words.collect()] == [("en", 12 * 1500)]
    assert counts.count() <= rows_of_phrases(spark, last)[0] <= 2 * counts.count()


def test_rows_that_move_between_passes(spark, monkeypatch):
    """Phrases that no task finds to be its own get their words all the same."""
    rows = fixture(5)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    monkeypatch.setattr(phrases.F, "spark_partition_id", lambda: F.lit(77))
    got = sorted(tuple(r) for r in phrases.collocations(df, support=4).collect())
    assert got == brute(rows, 4, 2000)


def test_long_words_whose_powers_agree(spark):
    """Thue-Morse words have equal polynomials modulo 2^64, whatever the base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(f"{one} x. {other} x", "en")] * 5 + [(f"{one} x", "en")]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), support=3).collect())
    assert [r[3] for r in got] == [6, 5] and got == brute(rows, 3, 2000)
