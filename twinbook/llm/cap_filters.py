"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation
a vector's dimensions are cut into blocks, each with its own random codewords,
and every combination of codewords is a direction. Each vector is list-decoded
to all directions whose inner product with it exceeds the height of its cap,
which is set so that every code lists LISTED directions (a common height leaves
many vectors without any); vectors of one label that share a direction are
compared exactly, in double precision.

The number of directions grows with the largest label, so that the vectors per
direction stay near LISTED at every size. Equal vectors are compared once.
Vectors of one direction are compared in blocks of at most about PER_BLOCK, so
that a crowded direction spreads over many tasks. Measured recall of links at
cosine 0.98 is given in the README.

Edge cases: a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of unlike lengths do not link;
a row without id has no links, a null component and is not kept; repeated rows
count as vectors of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut

#: Blocks of the product code, independent codes, directions that each code
#: lists for a vector, vectors compared in one block.
CODE_BLOCKS, TABLES, LISTED, PER_BLOCK = 3, 2, 8, 256
SEED = 20240607


class ProductCode:
    """Random product code over ``dim`` dimensions; each block's codewords are ``bases`` orthonormal bases and their negatives.

    Codewords in such tight, balanced sets give every vector scores of the same
    mean and spread, so that no vector is far from the caps of all directions.
    """

    def __init__(self, dim: int, bases: int, table: int):
        rng = np.random.default_rng(SEED + 1000 * table + dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        blocks = min(CODE_BLOCKS, dim)
        cuts = np.linspace(0, dim, blocks + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.books = []
        for s in self.slices:
            q = np.concatenate([np.linalg.qr(rng.standard_normal((s.stop - s.start,) * 2))[0] for _ in range(bases)])
            self.books.append(np.concatenate([q, -q]) / np.sqrt(blocks))
        self.words = max(len(b) for b in self.books)
        self.first = table * self.words**blocks

    @staticmethod
    def bases(dim: int, n: int) -> int:
        """Enough bases for about as many directions as vectors."""
        blocks = min(CODE_BLOCKS, dim)
        return max(1, round(n ** (1 / blocks) * blocks / dim / 2))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The LISTED directions of highest score for each unit vector: those above the height of its own cap.

        A direction among the best LISTED has codewords among the best LISTED of
        every block, so that only their combinations are scored.
        """
        x = unit @ self.rotation
        code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for s, book in zip(self.slices, self.books, strict=True):
            scores = x[:, s] @ book.T
            word = np.argsort(-scores, axis=1)[:, :LISTED]
            code = (code[:, :, None] * self.words + word[:, None, :]).reshape(len(x), -1)
            total = (total[:, :, None] + np.take_along_axis(scores, word, 1)[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-total, axis=1)[:, :LISTED]
            code, total = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
        return np.sort(code + self.first, axis=1)


def cosine_classes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """Per row: id, n_links, component_id and kept (id = component_id)."""
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    ok = "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    one = cut(rows.where(ok).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    sizes = {r["d"]: r["n"] for r in one.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()}

    def decode(batches):
        codes = {d: [ProductCode(d, ProductCode.bases(d, n), t) for t in range(TABLES)] for d, n in sizes.items()}
        for batch in batches:
            lists, rep, m = batch.column(batch.schema.get_field_index("v")), batch.column(1), batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([lists[int(i)].values.to_numpy().astype(dtype) for i in at])
                unit = x.astype(np.float64)
                unit /= np.abs(unit).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for a in range(0, len(at), 128):
                    tables = [code.decode(unit[a : a + 128]) for code in codes[int(d)]]
                    found = np.concatenate(tables, axis=1)
                    take = pa.array(at[a : a + 128])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), rep.take(take), m.take(take), pa.array([v.tobytes() for v in x[a : a + 128]]), pa.array([f.tobytes() for f in found]), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))],
                        ["label", "rep", "m", "e", "fs", "f"],
                    )

    label = vectors.schema[label_col].dataType.simpleString()
    filters = one.select("label", "rep", "m", "v").mapInArrow(decode, f"label {label}, rep long, m long, e binary, fs binary, f array<long>")
    filters = filters.withColumn("f", F.explode("f")).withColumn("dim", F.length("e"))
    by = ["label", "dim", "f"]
    crowd = filters.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / PER_BLOCK))
    placed = filters.join(crowd, by).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    blocks = cut(placed.groupBy(*by, "block").agg(F.collect_list(F.struct("rep", "m", "e", "fs")).alias("x")))
    other = blocks.select(*by, F.col("block").alias("block_y"), F.col("x").alias("y"))
    crossed = blocks.join(other, by).where("block < block_y").select("f", "x", "y")
    inner = blocks.where(F.size("x") > 1).select("f", "x", F.expr("slice(x, 1, 0)").alias("y"))
    links = cut(crossed.unionByName(inner).mapInArrow(lambda b: _linked(b, dtype, threshold), "a long, b long, k long"))
    degree = links.where("k > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("k"))
    roots = components(links.select("a", "b"))
    about = one.join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    good, bad = rows.where(ok), rows.where(f"not coalesce({ok}, false)")
    joined = good.join(about, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("id", "n_links", "root")
    out = joined.unionByName(bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(False)).alias("kept"))


def _linked(batches, dtype, threshold: float):
    """For two blocks (or one with itself, if y is empty): each linked vector a, with k, its links here, and b, the least vector that it is connected with here.

    Links are pairs that reach the threshold and share no earlier direction. They
    are counted and spanned, not listed: a block gives one row per vector at most.
    """

    def unpack(items):
        e = np.frombuffer(b"".join(i["e"] for i in items), dtype).reshape(len(items), -1).astype(np.float64)
        e = e / np.abs(e).max(1, keepdims=True)
        return np.array([i["rep"] for i in items]), np.array([i["m"] for i in items]), e / np.linalg.norm(e, axis=1, keepdims=True), [np.frombuffer(i["fs"], np.int64) for i in items]

    for batch in batches:
        for f, xs, ys in zip(*(batch.column(i) for i in range(3)), strict=True):
            f, x, y = f.as_py(), xs.as_py(), ys.as_py()
            rep, m, e, fs = unpack(x + y)
            n, k = (len(x), len(x)) if y else (0, len(x))  # x with y, or x with itself
            close = np.zeros((len(rep), len(rep)), bool)
            close[:k, n:] = e[:k] @ e[n:].T >= threshold
            close |= close.T
            np.fill_diagonal(close, False)
            if not close.any():
                continue
            earlier = np.unique(np.concatenate([g[g < f] for g in fs]))
            if len(earlier):
                member = np.stack([np.isin(earlier, g, assume_unique=True) for g in fs]).astype(np.float32)
                close &= member @ member.T == 0
            least, now = None, rep
            while least is None or (now != least).any():
                least, now = now, np.minimum(now, np.where(close, now, np.iinfo(np.int64).max).min(1))
            some = close.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(least[some]), pa.array((close @ m)[some])], ["a", "b", "k"])
