"""Fill-in-middle: cut texts at unit boundaries and move the middle to the end.

The unit ends of a text form a set of byte offsets, kept as in a Roaring bitmap:
a container for each 2**16 offsets, which is a sorted array, a bitmap or a list
of runs, whichever is smallest, and the cardinalities before each container. A
cut after k units is the set's element k: the container is found in the
cumulative cardinalities, the element inside it by a local select. The sets of
all texts of a batch share their tables, so that one call selects all cuts.

The draws are groups of digits of a hash of seed and id; nothing else is random.
Cuts depend on a row alone; the job has no shuffle, and a lost task is repeated
with the same result.

Edge cases: a null text is an empty one; empty texts, and texts that contain a
marker, stay plain; a null id draws like the empty string; a text of blanks is
one unit; texts of any length are cut as a whole; repeated rows are cut alike;
an empty table gives an empty result; other columns pass by, those named like an
output (n, form, prefix_chars, middle_chars, output) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of texts that are cut, and of those that take the form suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 50, 80
ARRAY, BITMAP, RUNS = range(3)
_BITMAP_BYTES = 1 << 13
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class BoundarySets:
    """A set of offsets for each text of a batch, in containers of 2**16 offsets.

    ``text`` (which set) and ``offset`` are sorted together, without repeats;
    each of the ``n_texts`` sets may be empty.
    """

    def __init__(self, text: np.ndarray, offset: np.ndarray, n_texts: int):
        high, low = offset >> 16, (offset & 0xFFFF).astype(np.uint16)
        edge = np.ones(len(offset), bool)
        edge[1:] = (high[1:] != high[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(edge)
        self.high = high[begin]
        #: Elements of all sets before each container, and before each set.
        self.before = begin.astype(np.int64)
        self.of_text = np.searchsorted(text, np.arange(n_texts + 1))
        size = np.diff(np.append(begin, len(offset)))
        container = np.cumsum(edge) - 1
        opens = edge.copy()
        opens[1:] |= low[1:] != low[:-1] + np.uint16(1)
        runs = np.bincount(container[opens], minlength=len(begin))
        bytes_of = np.stack([2 * size, np.full(len(size), _BITMAP_BYTES), 4 * runs])
        self.kind = bytes_of.argmin(axis=0) if len(size) else np.zeros(0, np.int64)
        kind = self.kind[container]
        #: Where the local tables of a container begin, in elements of its kind.
        self.base = np.zeros(len(size), np.int64)
        for k in (ARRAY, BITMAP, RUNS):
            mine = self.kind == k
            self.base[mine] = np.cumsum(size[mine]) - size[mine]
        self.array = low[kind == ARRAY]
        in_bitmap = kind == BITMAP
        place = (np.cumsum(self.kind == BITMAP) - 1)[container[in_bitmap]] * 1024 + (low[in_bitmap] >> 6)
        self.words = np.zeros(int((self.kind == BITMAP).sum()) * 1024, np.uint64)
        np.bitwise_or.at(self.words, place, np.uint64(1) << (low[in_bitmap] & np.uint16(63)).astype(np.uint64))
        self.words_before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        first = np.flatnonzero(opens & (kind == RUNS))
        self.run_start = low[first].astype(np.int64)
        self.run_before = (np.cumsum(kind == RUNS) - 1)[first]

    def sizes(self) -> np.ndarray:
        """Number of elements of each set."""
        return np.diff(self.of_text)

    def select(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Element ``k`` (from 0) of the set of each ``text``."""
        rank = self.of_text[text] + k
        container = np.searchsorted(self.before, rank, "right") - 1
        local = self.base[container] + rank - self.before[container]
        kind, out = self.kind[container], np.zeros(len(rank), np.int64)
        mine = kind == ARRAY
        out[mine] = self.array[local[mine]]
        mine = kind == RUNS
        run = np.searchsorted(self.run_before, local[mine], "right") - 1
        out[mine] = self.run_start[run] + local[mine] - self.run_before[run]
        mine = kind == BITMAP
        word = np.searchsorted(self.words_before, local[mine], "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        nth = (local[mine] - self.words_before[word])[:, None]
        out[mine] = (word % 1024) * 64 + (np.cumsum(bits, axis=1) > nth).argmax(axis=1) if len(word) else 0
        return (self.high[container] << 16) | out


def _word_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit ends behind each byte; units are words with the blanks before them, or blanks at a text's end."""
    blank = _BLANK[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    return ends


def _char_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same for code points."""
    ends = np.ones(len(data), bool)
    ends[:-1] = (data[1:] & 0xC0) != 0x80
    return ends


UNITS = {"word": _word_ends, "char": _char_ends}


def boundary_sets(data: np.ndarray, offsets: np.ndarray, unit: str = "word") -> BoundarySets:
    """The boundaries of each text: 0 and the byte offsets at which units end."""
    ends = np.flatnonzero(UNITS[unit](data, offsets)) + 1
    n = len(offsets) - 1
    text = np.searchsorted(offsets, ends - 1, "right") - 1
    text, offset = np.append(np.arange(n), text), np.append(np.zeros(n, np.int64), ends - offsets[text])
    order = np.lexsort((offset, text))
    return BoundarySets(text[order], offset[order], n)


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array, unit: str) -> pa.Array:
    """Per text: units, and code points before the first cut and between the cuts."""
    draws = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (first, second)]
    found = []
    for lo, hi, data, offsets in text_chunks(texts):
        sets = boundary_sets(data, offsets, unit)
        row, n = np.arange(hi - lo), sets.sizes() - 1
        a, b = (d[lo:hi] % (n + 1) for d in draws)
        at = [sets.select(row, k) + offsets[:-1] for k in (np.minimum(a, b), np.maximum(a, b))]
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        found.append(np.stack([n, chars[at[0]] - chars[offsets[:-1]], chars[at[1]] - chars[at[0]]]))
    n, prefix, middle = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, prefix, middle)], ["n", "prefix", "middle"])


def cut_column(text: Column, first: Column, second: Column, unit: str = "word") -> Column:
    """Struct (n, prefix, middle) of each text; the cuts come after first % (n + 1) and second % (n + 1) units."""

    @F.arrow_udf("n long, prefix long, middle long")
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _cuts(texts, a, b, unit)

    return cut(text, first, second)


def draws(id_column: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit draws of a row."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def with_middle_moved(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, unit: str = "word") -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    bounded_batches(docs.sparkSession)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    text = F.coalesce(docs[text_col], F.lit(""))
    h = draws(docs[id_col], seed)
    plain = (text == "") | (h[2] % 100 >= CUT_SHARE)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(marker))
    form = F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*kept).alias("row"), text.alias("text"), form.alias("form"), cut_column(text, h[0], h[1], unit).alias("cut"))
    text, cut, cut_up = F.col("text"), F.col("cut"), F.col("form") != "plain"
    prefix = F.substring(text, F.lit(1), cut["prefix"].cast("int"))
    middle = F.substring(text, (cut["prefix"] + 1).cast("int"), cut["middle"].cast("int"))
    suffix = F.substring(text, (cut["prefix"] + cut["middle"] + 1).cast("int"), F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    return rows.select("row.*", cut["n"].alias("n"), "form", F.when(cut_up, cut["prefix"]).alias("prefix_chars"), F.when(cut_up, cut["middle"]).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    A text with a marker is never cut, and none can arise where parts meet: the
    first occurrence of a marker is the one that was put there.
    """
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.split_part(rest, second, F.lit(1))
    rest = F.substr(rest, F.length(one) + len(PREFIX) + 1)
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
