"""The language model: exact counts and base scores, proper probabilities, gain on texts held out."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinbook.llm import maxent


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


def brute(rows):
    counts = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)] += 1
    return out


def fixture():
    """Texts in two invented languages, each with its own words and order."""
    rng = random.Random(9)
    tongues = [[f"{a}{b}{c}" for b in "aeiou" for c in end] for a, end in (("ka", ["ra", "to", "mi"]), ("schn", ["ung", "heit", "er"]))]
    rows = [(0, None), (1, ""), (2, " \t"), (None, "KARA kato"), (3, "x" * 5000), (10, "unseen " * 50)]
    for i in range(400):
        tongue, at, words = tongues[i % 2], rng.randrange(15), []
        for _ in range(rng.randrange(1, 60)):
            at = (at + rng.choice([1, 1, 1, 4])) % 15
            words.append(tongue[at] if rng.random() < 0.95 else f"r{rng.randrange(10**6)}")
        rows.append((20 + i, " ".join(words)))
    return rows + rows[-2:]


def test_hash_index():
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 40, 900).astype(np.uint64), rng.integers(0, 2**60, 900).astype(np.uint64)
    index = maxent.HashIndex(first, second)
    assert np.array_equal(index.find(first, second), np.arange(900))
    assert (index.find(first, second + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("table", [maxent.TABLE, 9, 0])
def test_base_scores(spark, monkeypatch, table):
    monkeypatch.setattr(maxent, "TABLE", table)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "k", 1, 2.0) for i, t in rows], "doc_id long, text string, row string, n int, score double").repartition(3)
    out = maxent.text_scores(df)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == brute(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if table == maxent.TABLE and table > 9:
        held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 20]
        assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.text_scores(df).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:5], "doc_id long, text string")
    for r in maxent.text_scores(only_held).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and math.isfinite(r["score"])


def test_chances_sum_to_one():
    """After training: over all events that may follow a history."""
    rng = np.random.default_rng(2)
    n = 5000
    rows = np.stack([np.arange(n), np.arange(n) * 7 + 1, rng.integers(0, maxent.SUFFIXES, n), rng.integers(1, 900, n)], axis=1)
    words = maxent.Vocabulary(rows)
    classes = rng.integers(0, maxent.CLASSES, maxent._NO_UNIT)
    suffix_counts = np.zeros((maxent.SUFFIXES, 2), np.int64)
    np.add.at(suffix_counts, rows[:, 2], np.stack([rows[:, 3], np.ones(n, np.int64)], axis=1))
    model = maxent.Model(words, classes, suffix_counts)
    counts = [np.zeros(maxent.ROWS, np.float32) for _ in range(2)]

    def text(at):
        return maxent.Tokens(np.zeros(len(at), np.int64), words.first[at], words.second[at], rows[at, 2], np.array([0, len(at)]))

    for _ in range(5):
        t = text(rng.integers(0, n, 600))
        found, *targets = model.rows(t, words.look_up(t)[1])
        for i in (0, 1):
            model.learn(i, found[i], targets[i], counts[i])
    total = 0.0
    for event in [*range(n), *(-1 - c for c in range(maxent.CLASSES))]:
        at = np.array([3, 77, 5, max(event, 0)])
        t = text(at)
        unit = words.look_up(t)[1]
        if event < 0:  # any other word of a class
            suffix = np.flatnonzero(classes[maxent.UNITS :] == -1 - event)
            unit[-1] = maxent.UNITS + suffix[0]
        found, target, slot = model.rows(t, unit)
        chance = model.log_chance(found, (target, slot))[-1]
        if slot[-1] == maxent.SLOTS - 1:
            chance += math.log((rows[event, 3] if event >= 0 else 0) + maxent.ADDED) - math.log(model.rest[target[-1]])
        total += math.exp(chance)
    assert abs(total - 1) < 1e-3
