"""Shared helpers: Arrow batches, text chunks, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.checkpoints import cut, shared_dir

#: Rows and bytes that one Arrow batch may carry to a Python worker.
BATCH_ROWS, BATCH_BYTES = 5000, 4 << 20
#: Bytes of text that the numpy kernels take at a time, so that their 64-bit
#: work arrays stay in a core's cache.
CHUNK_BYTES = 1 << 18


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle and checkpoint files that nothing refers to any more.

    The cleaner acts when the driver's JVM collects its garbage, which a job
    that is light on the driver may not do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one operator run, written as Parquet in the shared folder and read again, which cuts lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def free(self, *names: str) -> None:
        """Delete tables that nothing will read any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def numbers(rows: DataFrame) -> np.ndarray:
    """A table of long columns without nulls, of bounded size, as an array (rows, columns) on the driver.

    One task packs it into bytes, so that the driver holds no object per row.
    """
    width = len(rows.columns)

    def pack(batches):
        parts = [np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes() if parts else b""], pa.binary())], ["bytes"])

    found = [r["bytes"] for r in rows.coalesce(1).mapInArrow(pack, "bytes binary").collect()]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, width)


def text_chunks(
    column: pa.Array, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose UTF-8 bytes fit ``limit`` (a longer row comes alone).

    Yields (first row, row after the last, bytes, offsets of the rows in them).
    Nulls count as empty texts. The bytes are a view of the Arrow buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): one row (node, root).

    ``root`` is the smallest node of the component. Alternates the large-star
    and small-star steps, which need O(log^2 n) rounds; each round is a join of
    the edges with one minimum per node, so a node with very many neighbours is
    pre-aggregated and its rows can be split by adaptive skew joins. Nodes
    without links do not appear; links of a node with itself and rows with
    nulls are ignored; no links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(
        links.select("a", "b").where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.when(b == F.col("m"), F.array(F.struct(a, F.col("m").alias("b")))).otherwise(
                    F.array(F.struct(b.alias("a"), F.col("m").alias("b")))
                )
            ).alias("e")
        ).select("e.a", "e.b").where(a != b).distinct()
        edges = cut(small)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(a.alias("node"), b.alias("root"))
    return roots.union(edges.select(b.alias("node"), b.alias("root")).distinct())
