"""Full-text search with BM25 ranks, from an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame) -> DataFrame:
    """(term, id, tf, words) of documents (id, text)."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = docs.select("id", words.alias("w")).select("id", F.size("w").alias("words"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("words").alias("words"))


def search(docs: DataFrame, query: list[str]) -> DataFrame:
    """(id, score): documents with every term of the query.

    Each document's words are counted where it is read: the first pass gives the
    corpus's size and the terms' frequencies, the second the scores.
    """
    terms = sorted(set(query))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    count = lambda term: F.size(F.filter("w", lambda w: w == term)).alias(f"tf_{terms.index(term)}")
    rows = docs.select("id", words.alias("w")).select("id", F.size("w").alias("words"), *(count(t) for t in terms))
    found = [F.col(f"tf_{k}") > 0 for k in range(len(terms))]
    size = rows.agg(F.count("*").alias("docs"), F.coalesce(F.avg("words"), F.lit(1.0)).alias("mean"), *(F.count_if(f).alias(f"df_{k}") for k, f in enumerate(found))).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(F.lit(1 + (size["docs"] - size[f"df_{k}"] + 0.5) / (size[f"df_{k}"] + 0.5)))
        tf = F.col(f"tf_{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / size["mean"]))
    there = F.lit(bool(terms))
    for f in found:
        there = there & f
    return rows.where(there).select("id", score.alias("score"))
