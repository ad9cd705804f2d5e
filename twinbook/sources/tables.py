"""Reading tables, logs and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNAL = "ts string, key string, a_title string, b_title string, net_accurate double, a_close string, b_close string"
VERDICT = "ts string, a string, b string, same boolean, same_event boolean, reason string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON-lines log; malformed lines are dropped. ``line_no`` orders lines of one file."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def catalog_events(spark: SparkSession, path: str, schema: str | T.StructType, markets: str = "markets") -> DataFrame:
    """Nested catalog pages, one row per market; events without markets are kept."""
    return spark.read.schema(schema).json(path).withColumn("market", F.explode_outer(markets)).drop(markets)


def first_of(rows: DataFrame, *ids: str, order: str | None = None) -> DataFrame:
    """One row for each id, the first of ``ids`` that is not null or empty: the first by ``order`` (a column), rows without an id as one."""
    key = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids))
    place = F.col(order) if order else F.monotonically_increasing_id()
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct("*"), place).alias("_row")).select("_row.*")


def keyword_filter(rows: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """Rows whose text contains any keyword, whatever the case."""
    words = F.array(*(F.lit(k.lower()) for k in keywords))
    return rows.where(F.exists(words, lambda k: F.contains(F.lower(F.col(column)), k)))


def list_column(value: Column) -> Column:
    """A JSON list given as text, as an array of strings."""
    return F.from_json(value, "array<string>")
