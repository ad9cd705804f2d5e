"""Fill-in-middle against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinbook.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, unit="word"):
    text = text or ""
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = TOKEN.findall(text) if unit == "word" else list(text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind", ["array", "bitmap", "runs", "mixed"])
def test_boundary_sets_select(kind):
    rng = np.random.default_rng(3)
    sets = {
        "array": [np.array([0, 5, 70000, 200001])], "bitmap": [np.arange(0, 150000, 2), np.zeros(0, int), np.sort(rng.choice(65536, 20000, False))],
        "runs": [np.arange(70000), np.r_[3:9, 100:4000, 65530:65540]], "mixed": [np.array([0]), np.arange(66000), np.sort(rng.choice(400000, 50000, False)), np.array([1, 9])],
    }[kind]
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = fill_middle.BoundarySets(text, np.concatenate(sets).astype(np.int64), len(sets))
    assert found.sizes().tolist() == [len(s) for s in sets]
    if kind != "mixed":
        assert getattr(fill_middle, kind.upper()) in found.kind
    for i, s in enumerate(sets):
        assert np.array_equal(found.select(np.full(len(s), i), np.arange(len(s))), s)


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_middle(spark, unit):
    rng = np.random.default_rng(7)
    texts = [None, "", " ", " \t\n", "word", "two  words ", "a <P> b c", "x<S>", "<M", "<<P", "é ü <S", "a " * 60000, "x" * 70000, "naïve text 𝔘nits ok"]
    texts += ["".join(rng.choice(list("ab é\n<>PSM𝔘 "), rng.integers(1, 80))) for _ in range(120)] + ["same text here now"] * 2
    rows = [(None if i == 5 else i // 2 * 2, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, cut int")
    out = fill_middle.with_middle_moved(df, unit=unit)
    assert out.columns == ["doc_id", "text", "cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], unit)
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.with_middle_moved(df.limit(0), unit=unit).count() == 0
