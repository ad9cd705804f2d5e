"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark expressions. Trees grown on labelled rows
give conjunctive rules, one for each path from the root to a node; a logistic
regression with an L1 penalty weighs them; the rules that keep a weight are
compiled into one Spark column expression, which scores every row.

Edge cases: a null text is an empty one; an empty text has statistics zero and
gets a score like any other; labels that are null or of ids without a text are
ignored, and of several labels for one id the largest counts; without labels of
both classes every score is the share of label 1 (one half without labels);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

TREES, DEPTH, PENALTY, SEED = 16, 3, 0.001, 7
#: Labelled rows that a task of the fitting reads.
TASK_ROWS = 20_000
#: Up to this many rejected rows (some 30 MB of keys) are sent to the texts by a broadcast.
BROADCAST_ROWS = 1_000_000
#: A rule is a list of (statistic, is_above, threshold); a model is (intercept, [(weight, rule)]).
Rule = list[tuple[str, bool, float]]
Model = tuple[float, list[tuple[float, Rule]]]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; shares are of characters, words or lines."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    share = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words = F.size(words)
    distinct = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "upper": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "symbols": share(r"[#$%&*!~^<>{}\[\]=+@_/\\]+"),
        "pipes": share(r"\|+"),
        "stops": share("[.,;:?]+"),
        "space": share(r"\s+"),
        "word_chars": n / F.greatest(n_words, F.lit(1)),
        "distinct_words": distinct(words),
        "distinct_lines": distinct(lines),
        "line_words": n_words / F.greatest(F.size(lines), F.lit(1)),
    }


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _paths(node, names: list[str], so_far: Rule) -> list[Rule]:
    """The rules of all nodes below a tree node."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    name, cut_at = names[node.split().featureIndex()], node.split().threshold()
    low, high = [*so_far, (name, False, cut_at)], [*so_far, (name, True, cut_at)]
    return [low, *_paths(node.leftChild(), names, low), high, *_paths(node.rightChild(), names, high)]


def holds(rule: Rule) -> Column:
    """A rule as a boolean column over the statistics' columns."""
    out = F.lit(True)
    for name, above, cut_at in rule:
        out = out & ((F.col(name) > cut_at) if above else (F.col(name) <= cut_at))
    return out


def fit(labelled: DataFrame, names: list[str]) -> Model:
    """Rules and weights from rows with the statistics ``names`` and ``quality`` (0 or 1)."""
    counts = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), []
    rows = labelled.select(array_to_vector(F.array(*names)).alias("x"), F.col("quality").cast("double").alias("y"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=SEED).fit(rows)
    rules: list[Rule] = []
    for tree in forest.trees:
        rules += [r for r in _paths(tree._call_java("rootNode"), names, []) if r not in rules]
    if not rules:
        share = counts[1] / sum(counts.values())
        return math.log(share / (1 - share)), []
    tidy(labelled.sparkSession)
    fired = labelled.select(
        array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("x"), F.col("quality").cast("double").alias("y")
    )
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, standardization=True, maxIter=50).fit(fired)
    weights = [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if abs(w) > 1e-6]
    return float(lasso.intercept), weights


def score(model: Model) -> Column:
    """A model compiled into a column over the statistics' columns, 0 to 1."""
    intercept, rules = model
    total = F.lit(intercept)
    for weight, rule in rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, _key (a hash of the text) and score. Fits on labelled rows that are not held out, of any number."""
    stats = statistics(F.col(text_col))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = cut(docs.select(F.col(id_col).alias("_id"), key.alias("_key"), *(c.cast("double").alias(k) for k, c in stats.items())))
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    labelled = cut(rows.where(~held_out(F.col("_id"))).join(known, "_id").select("quality", *stats))
    # Fitting passes over these short rows many times: few, full tasks.
    labelled = labelled.coalesce(1 + labelled.count() // TASK_ROWS)
    model = fit(labelled, list(stats))
    # The driver has compiled a plan for every pass; free what they left.
    tidy(docs.sparkSession)
    return rows.select("_id", "_key", score(model).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    rows = scored(docs, labels, id_col, text_col)
    out = rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score one half or more; a row without id is kept or dropped by its text alone."""
    bad = cut(scored(docs, labels, id_col, text_col).where("score < 0.5").select("_id", "_key").distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")
