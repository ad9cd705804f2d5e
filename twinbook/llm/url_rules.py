"""URL allow and block rules by a sort-merge range join.

A host's labels in reverse order are its canonical key, so that a rule's host
with all its subdomains is an interval of keys. Urls and rules are cut into
ranges of that order; in each range one sweep over the sorted keys keeps a stack
of the rules' hosts that are open, each nested in the one below.

Edge cases: null urls and urls without ``://`` have an empty host and path and
get the default verdict; of rules that fit, the longest (host and path together,
then the host) wins, and of equal rules 'allow'; rules with a null host, path or
verdict never fit; no rules, or no urls, are fine; repeated rows are judged each
on its own; columns of the input pass by untouched, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: The first of these is the verdict where no rule fits.
DEFAULT, BLOCK = "allow", "block"
#: Split points come from about this many sampled keys for each range; they
#: balance the ranges and do not affect results.
SAMPLE_PER_RANGE = 20
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url):
    """Columns (host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path then up to ``? #``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), *_LOWER), F.regexp_extract(url, parts, 2)


def _key(host):
    """Labels in reverse, each ended by the least character: a subdomain's key begins with its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    ``rules``: host, path (a prefix), verdict (allow or block). The rule column
    is the rule's host and path together, null if none fits.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(f"`{url_col}`"))
    made = ("host", "path", "rule", "verdict")
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in made or c == url_col))
    urls = pages.select(row.alias("row"), host.alias("host"), path.alias("path")).withColumn("key", _key(F.col("host")))
    # Equal hosts are told apart by the whole url, so that a hot host spreads over ranges.
    urls = urls.withColumn("place", F.concat("key", "path", F.xxhash64("row").cast("string")))
    splits = _split_points(urls, ranges)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda p: bisect_right(splits, p)).astype("int32")

    urls = urls.withColumn("part", range_of("place"))
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        _key(F.translate("host", *_LOWER)).alias("key"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    # A rule goes to every range that its interval [key, key + last character) meets.
    spread = rules.withColumn("lo", range_of("key")).withColumn("hi", range_of(F.concat("key", F.lit("\U0010FFFF"))))
    spread = spread.withColumn("part", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    events = urls.withColumn("kind", F.lit(1)).unionByName(spread.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    events = events.repartition(ranges, F.col("part")).sortWithinPartitions("part", "key", "kind").select(
        "row", "host", "path", "key", "part", "kind", "rule_host", "rule_path", "rule_verdict"
    )
    schema = T.StructType([T.StructField("row", urls.schema["row"].dataType)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    judged = events.mapInArrow(_sweep, schema)
    return judged.select(*(F.col("row").getField(c).alias(c) for c in pages.columns if c not in made), *made)


def _split_points(urls: DataFrame, ranges: int) -> list[str]:
    """ranges - 1 keys that cut the urls evenly, from a sample of bounded size."""
    want = ranges * SAMPLE_PER_RANGE
    keys = urls.select("place").sample(min(1.0, want / max(1, urls.count())), seed=1).limit(4 * want)
    keys = sorted(r[0] for r in keys.collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def _sweep(batches):
    """Rules push their host on the stack; urls look at the open hosts, the innermost last."""
    part, stack = None, []  # stack: (key, {path: (length, host length, allows, rule, verdict)}, path lengths)
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(2, 9)]
        keep, rules, verdicts = [], [], []
        for i, (path, key, where, kind, r_host, r_path, r_verdict) in enumerate(zip(*columns, strict=True)):
            if where != part:
                part, stack = where, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                at = (len(r_host) + len(r_path), len(r_host), r_verdict == DEFAULT, r_host + r_path, r_verdict)
                held = stack[-1][1]
                held[r_path] = max(at, held.get(r_path, at))
                stack[-1][2].add(len(r_path))
                continue
            fits = [held[path[:n]] for _, held, lengths in stack for n in lengths if n <= len(path) and path[:n] in held]
            best = max(fits, default=None)
            keep.append(i)
            rules.append(best and best[3])
            verdicts.append(best[4] if best else DEFAULT)
        if keep:
            out = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [out.column(0), out.column(1), out.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                ["row", "host", "path", "rule", "verdict"],
            )
