"""Removal of repeated byte strings: a depth-limited radix sort of suffixes.

Suffixes are compared through ``length`` bytes only, by passes over digits of
growing depth; what is alone in its group after a pass leaves. The first digit
is read at anchors only: of every ``length``-byte window the GRAM-byte string
with the least hash, which equal windows choose alike, stands for the window.

1. Digit one: anchors by their GRAM bytes. Lone anchors leave, and with them all
   windows that they stand for.
2. Digit two: what is left, by all bytes of the windows that the anchor stands
   for. Anchors with equal bytes are settled: all their windows repeat. Where an
   anchor's group holds several kinds of such bytes, one of each kind goes on.
3. Digit three: their windows in blocks of BLOCK neighbours, by the bytes that
   all windows of the block share; lone blocks leave. Blocks whose windows' bytes
   are equal altogether are settled.
4. Last digit: the single windows of the other blocks, by all their bytes.
   Equal groups are exactly the repeated windows.

Equal texts are sorted once. Edge cases: null and empty texts, and texts shorter
than ``length``, lose nothing; equal texts of at least ``length`` bytes lose all
their bytes; a row without id is kept and loses what its bytes repeat; other
columns pass by untouched, whatever their names; an empty table gives an empty
result. Digits are compared by 64-bit hashes that include the first digit's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, bounded_batches, cut, mix64, text_chunks, tidy

GRAM, BLOCK = 32, 16
#: Up to this many keys or byte ranges are sent to the texts by a broadcast (at
#: most some 90 MB); more meet them in a shuffle.
BROADCAST_ROWS = 1_200_000
_MULT = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a concatenation from its halves' hashes."""
    x = left * _MULT
    x += right
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def _levels(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 1, 2, 4 .. ``top`` bytes, by first byte."""
    out = {1: _BYTE[data]}
    size = 1
    while size < top:
        h = out[size]
        out[2 * size] = _joined(h[: len(h) - size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    return out


def _top(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _span_hash(levels: dict[int, np.ndarray], start: np.ndarray, end: np.ndarray, top: int) -> np.ndarray:
    """Hashes of the strings [start, end), each of ``top`` bytes or more, by overlapping blocks."""
    h = levels[top]
    out = mix64((end - start).astype(np.uint64))
    for k in range(int((end - start).max() - 1) // top + 1 if len(start) else 0):
        out = np.where(start + k * top < end, _joined(out, h[np.minimum(start + k * top, end - top)]), out)
    return mix64(out)


def _anchors(levels: dict[int, np.ndarray], n_windows: int, length: int, gram: int) -> np.ndarray:
    """For every window of ``length`` bytes, the place of its gram with the least hash, the leftmost of ties."""
    n = n_windows + length - gram
    key = (mix64(levels[gram][:n]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[:n_windows], key[width - size : width - size + n_windows])
    return (key[:n_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (bytes, row of each text in them, its offset, bytes of that text before the chunk).

    A very long text is read in pieces that overlap by length - 1 bytes, so
    that each window lies in exactly one piece.
    """
    for first, last, data, offsets in text_chunks(column):
        if last - first == 1 and len(data) > 2 * CHUNK_BYTES:
            for at in range(0, len(data) - length + 1, CHUNK_BYTES):
                part = data[at : at + CHUNK_BYTES + length - 1]
                yield part, np.array([first]), np.array([0, len(part)]), np.array([at])
        else:
            yield data, np.arange(first, last), offsets, np.zeros(last - first, np.int64)


def _anchor_rows(batches, length: int, gram: int, digits: int):
    """(key, g, c, n, at, r): the n anchors of a text with equal digits g and c, where the first lies, and r, the first and last window start of each.

    With one digit only (g, n), n anchors of a chunk. So a string that recurs within a text is one row.
    """
    top = _top(length)
    for batch in batches:
        keys = batch.column(0)
        for data, rows, offsets, before in _pieces(batch.column(1), length):
            n = len(data) - length + 1
            if n <= 0:
                continue
            levels = _levels(data, top if digits > 1 else gram)
            anchor = _anchors(levels, n, length, gram)
            text = np.repeat(np.arange(len(rows)), np.diff(offsets))[:n]
            start = np.flatnonzero(np.arange(n) + length <= offsets[1:][text])
            if not len(start):
                continue
            a, t = anchor[start], text[start]
            new = np.ones(len(start), bool)
            new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
            i = np.flatnonzero(new)
            lo, hi = start[i], start[np.append(i[1:], len(start)) - 1]
            a, t = a[i], t[i]
            g = mix64(levels[gram][a] + np.uint64(gram))
            if digits == 1:
                each, many = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(many)], ["g", "n"])
                continue
            c = _span_hash(levels, lo, hi + length, top) ^ mix64((((a - lo) << 24) + (hi - lo)).astype(np.uint64))
            by = np.lexsort((c, g, t))
            a, t, lo, hi, g, c = (x[by] for x in (a, t, lo, hi, g, c))
            base = before[t] - offsets[:-1][t]
            a, lo, hi = ((x + base).astype(np.int32) for x in (a, lo, hi))
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
            ends = np.append(first, len(t))
            ranges = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows[t[first]])), pa.array(g[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(np.diff(ends)), pa.array(a[first]), ranges],
                ["key", "g", "c", "n", "at", "r"],
            )


def _asked(batches):
    """Ranges beside their texts: (key, bytes, base, fields) with an array of each field of the ranges.

    Bytes are those of several texts at once, and ``base`` is where a range's
    text begins in them; a very long text is given range by range.
    """
    for batch in batches:
        keys, lists = batch.column(0).to_numpy(), batch.column(2)
        ends = lists.offsets.to_numpy()
        fields = {f.name: lists.values.field(i).to_numpy() for i, f in enumerate(lists.type.value_type)}
        for first, last, data, offsets in text_chunks(batch.column(1)):
            row = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
            part = {n: v[ends[first] : ends[last]] for n, v in fields.items()}
            if len(data) <= 4 * CHUNK_BYTES:
                yield keys[row], data, offsets[row - first], part
            else:
                for k in range(len(row)):
                    yield keys[row[k : k + 1]], data, offsets[:1], {n: v[k : k + 1] for n, v in part.items()}


def _expanded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``count`` members: each member's group, and its place in it."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def _block_rows(batches, length: int):
    """(key, lo, hi, core, whole): the blocks of the asked ranges, with the hashes of their shared and of all their bytes."""
    top = _top(length - BLOCK + 1)
    for keys, data, base, r in _asked(batches):
        at, lo, hi = (r[n].astype(np.int64) for n in ("at", "lo", "hi"))
        start = int((base + lo).min()) if len(base) == 1 else 0
        levels = _levels(data[start : int((base + hi).max()) + length], top)
        i, k = _expanded((hi - at) // BLOCK - (lo - at) // BLOCK + 1)
        b = ((lo - at) // BLOCK)[i] + k
        first, last = np.maximum(lo[i], at[i] + b * BLOCK), np.minimum(hi[i], at[i] + b * BLOCK + BLOCK - 1)
        inner, shift, g = at[i] + b * BLOCK + BLOCK - 1, base[i] - start, r["g"].view(np.uint64)[i]
        core = mix64(_span_hash(levels, inner + shift, inner + shift + length - BLOCK + 1, top) ^ g) + b.astype(np.uint64)
        whole = _span_hash(levels, first + shift, last + shift + length, top) ^ mix64((first - at[i] + (1 << 20)).astype(np.uint64)) ^ g
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[i]), *(pa.array(x.astype(np.int32)) for x in (first, last)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
            ["key", "lo", "hi", "core", "whole"],
        )


def _window_rows(batches, length: int):
    """(key, p, w): place and last digit of each window in the asked ranges."""
    top = _top(length)
    for keys, data, base, r in _asked(batches):
        lo, hi = r["lo"].astype(np.int64), r["hi"].astype(np.int64)
        start = int((base + lo).min()) if len(base) == 1 else 0
        levels = _levels(data[start : int((base + hi).max()) + length], top)
        i, k = _expanded(hi - lo + 1)
        p = lo[i] + k
        at = p + base[i] - start
        w = mix64(_span_hash(levels, at, at + length, top) ^ r["core"].view(np.uint64)[i])
        yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(p.astype(np.int32)), pa.array(w.view(np.int64))], ["key", "p", "w"])


def _runs(batches):
    """Consecutive starts as ranges."""
    for batch in batches:
        keys, los, his = [], [], []
        for key, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            p = np.asarray(places.values)
            gap = np.flatnonzero(np.diff(p) > 1)
            lo, hi = p[np.append(0, gap + 1)], p[np.append(gap, len(p) - 1)]
            keys.extend([key] * len(lo))
            los.append(lo)
            his.append(hi)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(los)), pa.array(np.concatenate(his))], ["key", "lo", "hi"])


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)


def _checked(rows: DataFrame, lists: str | None = None) -> DataFrame:
    """A broadcast, if ``rows``, or the elements of their ``lists``, are few enough."""
    n = rows.agg(F.sum(F.size(lists))).first()[0] or 0 if lists else rows.count()
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _beside_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, text, ranges) of the keys in ``rows`` (key, ranges)."""
    rows = cut(rows)
    tidy(rows.sparkSession)
    return texts.join(_checked(rows, "ranges"), "key").select("key", "text", "ranges")


def repeated_windows(texts: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """(key, r): ranges (lo, hi) of starts, inclusive, of ``length``-byte strings that start elsewhere too.

    ``texts`` has key (long) and text (string). A key that comes twice is two texts.
    """
    if length <= 2 * BLOCK:
        raise ValueError(f"length must exceed {2 * BLOCK}")
    gram = _top(min(gram, length))
    grams = texts.mapInArrow(lambda b: _anchor_rows(b, length, gram, 1), "g long, n long")
    anchors = texts.mapInArrow(lambda b: _anchor_rows(b, length, gram, 2), "key long, g long, c long, n long, at int, r array<struct<lo:int,hi:int>>")
    found = cut(anchors.join(grams.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "g"))
    tidy(texts.sparkSession)
    kinds = found.groupBy("g", "c").agg(F.sum("n").alias("m"), F.min(F.struct("key", "at", F.col("r")[0]["lo"].alias("lo"), F.col("r")[0]["hi"].alias("hi"))).alias("one"))
    kinds = cut(kinds.join(kinds.groupBy("g").agg(F.count("*").alias("k")), "g"))
    settled = cut(found.join(kinds.where("m > 1").select("g", "c"), ["g", "c"]).select("key", "r"))

    one = F.array(F.struct("lo", "hi")).alias("r")
    asked = kinds.where("k > 1").groupBy("one.key").agg(F.collect_list(F.struct("one.at", "one.lo", "one.hi", "g")).alias("ranges"))
    blocks = cut(_beside_texts(texts, asked).mapInArrow(lambda b: _block_rows(b, length), "key long, lo int, hi int, core long, whole long"))
    blocks = cut(blocks.join(_repeated(blocks, "core"), "core"))
    tidy(texts.sparkSession)
    equal = blocks.join(_repeated(blocks, "core", "whole"), ["core", "whole"]).select("key", one)

    # Where a group of blocks holds several kinds, one block of each goes on.
    each = blocks.groupBy("core", "whole").agg(F.min(F.struct("key", "lo", "hi")).alias("one"))
    asked = each.join(_repeated(each, "core"), "core").groupBy("one.key").agg(F.collect_list(F.struct("one.lo", "one.hi", "core")).alias("ranges"))
    windows = cut(_beside_texts(texts, asked).mapInArrow(lambda b: _window_rows(b, length), "key long, p int, w long"))
    single = (
        windows.join(_repeated(windows, "w"), "w").groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("p"))
        .mapInArrow(_runs, "key long, lo int, hi int").select("key", one)
    )
    return settled.unionByName(equal).unionByName(single)


def row_keys(id_col: str, text_col: str):
    """A row's id (a hash of its text if it has none), and its text's hash."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), key), key


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM) -> DataFrame:
    """(_row, _key, removed): the byte runs [start, end) to remove, for texts that lose any.

    ``_row`` and ``_key`` are the values of ``row_keys`` and name a text.
    """
    bounded_batches(docs.sparkSession)
    row, key = row_keys(id_col, text_col)
    texts = docs.where(F.octet_length(text_col) >= length).select(row.alias("_row"), key.alias("_key"), F.col(text_col).alias("text"))
    named = cut(
        texts.select("_row", "_key", F.octet_length("text").alias("size")).distinct()
        .join(texts.groupBy("_key").agg(F.count("*").alias("copies"), F.min("_row").alias("one")), "_key")
    )
    # Copies lose all their bytes; one of them is compared with the other texts.
    more = named.where("copies > 1 and _row <> one").select("_row", "_key")
    single = texts.join(_checked(more), ["_row", "_key"], "left_anti")
    ranges = repeated_windows(single.select(F.col("_key").alias("key"), "text"), length, gram)
    lists = ranges.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("ranges"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def union(ranges: pd.Series) -> pd.Series:
        return _union(ranges, length)

    some = lists.select(F.col("key").alias("_key"), union("ranges").alias("removed"))
    whole = named.where("copies > 1").select("_row", "_key", F.expr("array(struct(0 as start, size as end))").alias("removed"))
    out = cut(named.where("copies = 1").join(some, "_key").select("_row", "_key", "removed").unionByName(whole))
    tidy(docs.sparkSession)
    return out


def with_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM) -> DataFrame:
    """``docs``, every row and column, with ``removed``: array of byte runs [start, end), in order, maximal.

    A column of that name is replaced.

    Removes each byte covered by a ``length``-byte string that also starts
    anywhere else, the same text included; overlaps count.
    """
    runs = repeated_runs(docs, id_col, text_col, length, gram)
    row, key = row_keys(id_col, text_col)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    others = [c for c in docs.columns if c != "removed"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc"), row.alias("_row"), key.alias("_key"))
    joined = rows.join(_checked(runs, "removed"), ["_row", "_key"], "left")
    return joined.select(*(F.col("doc").getField(c).alias(c) for c in others), F.coalesce("removed", none).alias("removed"))


def kept_bytes(text, removed):
    """The bytes of ``text`` (string column) outside the runs of ``removed``, as a binary column."""
    return _keep(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), removed)


def kept_text(text, removed):
    """``text`` without the characters that lie in the runs of ``removed`` with all their bytes."""
    return _keep_text(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), removed)


@F.pandas_udf(T.StringType())
def _keep_text(body: pd.Series, removed: pd.Series) -> pd.Series:
    def keep(b, runs):
        out, at = [], 0
        for r in runs:
            start, end = r["start"], r["end"]
            while start < end and b[start] & 0xC0 == 0x80:
                start += 1
            while start < end < len(b) and b[end] & 0xC0 == 0x80:
                end -= 1
            out.append(b[at:start])
            at = max(at, end)
        return b"".join([*out, b[at:]]).decode()

    return pd.Series([keep(b, runs) for b, runs in zip(body, removed, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _keep(body: pd.Series, removed: pd.Series) -> pd.Series:
    def keep(b, runs):
        ends = [0, *(r["end"] for r in runs)]
        return b"".join(b[i:j] for i, j in zip(ends, [*(r["start"] for r in runs), len(b)], strict=True))

    return pd.Series([keep(b, runs) for b, runs in zip(body, removed, strict=True)], dtype=object)


def _union(ranges: pd.Series, length: int) -> pd.Series:
    """Sorted inclusive ranges of window starts as maximal runs of covered bytes."""
    out = []
    for row in ranges:
        runs: list[dict] = []
        for r in row:
            if runs and r["lo"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], r["hi"] + length)
            else:
                runs.append({"start": r["lo"], "end": r["hi"] + length})
        out.append(runs)
    return pd.Series(out, dtype=object)
