"""Frequent phrases of two to four words and their cohesion, mined in partitions (SON).

1. Documents lie in shards. Each shard is mined completely, length by length, at
   the support's share that its words are of all words of the language, rounded
   up. A phrase that reaches the support reaches this share in some shard.
2. What is frequent in any shard, and by its counts of all shards reaches the
   support, is a candidate; one filter over the hashes of all candidates of a
   length goes to the tasks. A longer phrase is mined only where both its shorter
   parts pass; a filter lets more pass, never less. As what passes is counted in
   every shard, over all documents, the shards' sum is a phrase's count.
3. One more pass gives the candidates their words. Each is read by one task, the
   first of those that have counted it, so that as many rows come of it as there
   are candidates, however often and in however many tasks these occur. If the
   rows lie in other tasks by then, what is still without words is read by all.

A shard is a class of tasks, not a task: its counts are summed over tasks by a
shuffle, so that neither a shard's size nor its number of tasks matters. The
support is a number of occurrences, so more shards than SHARDS would lower the
local support to one and let everything pass.

Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` of a piece with
A-Z lower-cased. A candidate's score is the least over its cuts into two parts of
floor(2000000 * a / (l + r)), for counts a of the phrase and l, r of the parts.

Edge cases: null texts and texts without words add nothing; a null language is
``und``; words, texts and pieces of any length are whole; repeated rows count
each; equal scores go by count, then phrase; an empty table gives an empty
result; other columns are ignored. Counts are exact integers; phrases of a
language are told apart by 96 bits of two hashes (filters by the first 64). Long
words, for which powers modulo 2^64 can be made to agree, take a cryptographic
hash instead.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, numbers, text_chunks
from .words import WordReader, byte_kinds

SUPPORT, LONGEST, TOP, COVERED = 30, 4, 2000, 80
UNKNOWN_LANG = "und"
#: Classes of tasks that are mined each on its own; local support is about SUPPORT / SHARDS.
SHARDS = 10
#: Bits of a filter: FILTER_BITS for each candidate, between these powers of two. Fuller filters only let more pass.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Supports of (shard, language) up to this many are sent to all tasks.
BROADCAST_ROWS = 100_000
#: Bytes of text taken at a time, phrases that a task holds before it counts them together, and bytes of phrases sent at once.
CHUNK, HELD, HELD_BYTES = 1 << 19, 1 << 20, 24 << 20
#: Words of so many bytes are hashed one by one.
LONG_WORD = 256
#: Rows that go to the JVM at once.
SENT = 1 << 16
#: Classes in which ranks are taken before a language's best meet in one task.
CLASSES = 64
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_STEP = np.uint64(0xBF58476D1CE4E5B9)


class Candidates:
    """A filter over hashes: two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in (keys & self.mask, (keys >> np.uint64(36)) & self.mask):
            found &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> Candidates:
        """The filter of a table of keys (long); the bits are set by an aggregation, the driver gets the filter only."""
        power = min(MOST_BITS, max(LEAST_BITS, (FILTER_BITS * max(1, count) - 1).bit_length()))
        mask = F.lit((1 << power) - 1)
        place = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 36).bitwiseAND(mask)))
        words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        found = numbers(words)
        bits = np.zeros(1 << (power - 6), np.int64)
        bits[found[:, 0]] = found[:, 1]
        return cls(bits.view(np.uint8))


def _read(reader: WordReader, data: np.ndarray, offsets: np.ndarray):
    words = reader.read(data, offsets)
    for i in np.flatnonzero(words.end - words.start >= LONG_WORD):
        digest = blake2b(words.data[words.start[i] : words.end[i]].tobytes(), digest_size=16).digest()
        for h, value in zip(words.hashes, np.frombuffer(digest, np.uint64), strict=True):
            h[i] = value
    return words


def _marks(second: np.ndarray) -> np.ndarray:
    """What tells phrases of one key apart."""
    return (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _grams(words, langs: np.ndarray):
    """(length, whether a phrase begins at each word, its two hashes) for lengths from 1."""
    first, second = (h.copy() for h in words.hashes)
    salt = mix64(langs[words.text].astype(np.uint64) + np.uint64(1))
    whole = np.ones(len(first), bool)
    for k in range(1, LONGEST + 1):
        if k > 1:
            n = max(0, len(words.start) - k + 1)
            first, second = (mix64(a[:n] * _STEP + h[k - 1 : k - 1 + n]) for a, h in zip((first, second), words.hashes, strict=True))
            whole = words.piece[:n] == words.piece[k - 1 : k - 1 + n]
        yield k, whole, mix64(first ^ salt[: len(first)]), second


def _local_counts(length: int, shorter):
    """Maps batches of (lang, lang_key, text) to (task, lang_key, key, mark, n), counts of a task; a null key counts all words."""

    def run(batches):
        reader, task = WordReader(KINDS), TaskContext.get().partitionId()
        parts = shorter.value if shorter is not None else None
        held, total, size = [], {}, 0

        def out():
            key, mark, lang = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(key, kind="stable")
            key, mark = key[order], mark[order]
            edge = np.ones(len(key), bool)
            edge[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            first = np.flatnonzero(edge)
            n, lang = np.diff(np.append(first, len(key))), lang[order[first]]
            for at in range(0, len(first), SENT):
                part = slice(at, at + SENT)
                yield _rows(task, lang[part], pa.array(key[first[part]].view(np.int64)), mark[first[part]], n[part])

        for batch in batches:
            lang_keys = batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column(2), CHUNK):
                words, before = _read(reader, data, offsets), None
                for k, whole, key, second in _grams(words, lang_keys[lo:hi]):
                    if k == length - 1:
                        before = parts.has(key) & whole
                    if k == length:
                        break
                n = len(key)
                use = np.flatnonzero(whole & before[:n] & before[1 : n + 1]) if before is not None else np.flatnonzero(whole)
                held.append((key[use], _marks(second[use]), lang_keys[lo:hi][words.text[use]]))
                size += len(use)
                if length == 1:
                    for lang, n in zip(*np.unique(held[-1][2], return_counts=True), strict=True):
                        total[lang] = total.get(lang, 0) + n
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()
        if total:
            yield _rows(task, np.array(list(total), np.int64), pa.nulls(len(total), pa.int64()), np.zeros(len(total), np.int32), np.array(list(total.values()), np.int64))

    return run


def _rows(task: int, lang, key, mark, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), task, np.int32)), pa.array(lang), key, pa.array(mark), pa.array(n.astype(np.int64))], ["task", "lang_key", "key", "mark", "n"])


def _joined(words, at: np.ndarray, k: int) -> pa.Array:
    """The ``k`` words from each word ``at``, joined by spaces."""
    each = (at[:, None] + np.arange(k)).ravel()
    start, size = words.start[each], words.end[each] - words.start[each]
    gap = np.arange(1, len(each) + 1) % k > 0
    ends = np.cumsum(size + gap)
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    to = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(ends - gap - size, size) + to] = words.data[np.repeat(start, size) + to]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends[k - 1 :: k]).astype(np.int32)), pa.py_buffer(out))


def _slices(words, at: np.ndarray, k: int):
    """Parts of ``at`` whose phrases have some HELD_BYTES, or are one."""
    at_end = np.cumsum(words.end[at + k - 1] - words.start[at])
    cut = np.flatnonzero(np.diff(at_end // HELD_BYTES)) + 1
    return np.split(np.arange(len(at)), cut)


def _names(filters, owned):
    """Maps batches of (lang, lang_key, text, salt) to (lang, key, mark, phrase, n).

    What passes both its length's filter and, by the task's salt, ``owned`` comes
    once from a task, without n. A null phrase counts the words of a text.
    """

    def run(batches):
        reader, tests, mine = WordReader(KINDS), [f.value for f in filters], owned.value
        done = [np.zeros(0, np.uint64) for _ in tests]
        columns = ["lang", "key", "mark", "phrase", "n"]
        for batch in batches:
            lang_keys, names = batch.column(1).to_numpy(), batch.column(0)
            salts = batch.column(3).to_numpy().view(np.uint64)
            for lo, hi, data, offsets in text_chunks(batch.column(2), CHUNK):
                words = _read(reader, data, offsets)
                total = np.bincount(words.text, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.string()), pa.array(total.astype(np.int64))], columns)
                for k, whole, key, second in _grams(words, lang_keys[lo:hi]):
                    at = np.flatnonzero(whole)
                    at = at[tests[k - 1].has(key[at])]
                    if not len(at):
                        break
                    at = at[mine.has(key[at] ^ salts[0])]
                    # Told apart by both hashes: of two phrases with one key, each comes.
                    whose, first = np.unique(key[at] ^ mix64(second[at]), return_index=True)
                    new = ~np.isin(whose, done[k - 1], assume_unique=True)
                    done[k - 1], at = np.concatenate([done[k - 1], whose[new]]), at[first[new]]
                    for part in _slices(words, at, k) if len(at) else ():
                        some = at[part]
                        langs, phrases = names.take(pa.array(lo + words.text[some])), _joined(words, some, k)
                        yield pa.RecordBatch.from_arrays([langs, pa.array(key[some].view(np.int64)), pa.array(_marks(second[some])), phrases, pa.nulls(len(some), pa.int64())], columns)

    return run


def _supports(words: DataFrame, support: int) -> DataFrame:
    """(shard, lang_key, least): the support's share of a shard's words of a language, rounded up."""
    total = words.groupBy("lang_key").agg(F.sum("n").alias("all"))
    return words.join(total, "lang_key").select("shard", "lang_key", F.expr(f"greatest(1L, (cast({support} as decimal(10, 0)) * n + all - 1) div all)").alias("least"))


def _candidates(counted: DataFrame, supports: DataFrame, support: int, by: tuple[str, ...] = ("key",), more: tuple[Column, ...] = ()) -> DataFrame:
    """(by, n, more) of what is frequent in a shard, and has ``support`` occurrences in all shards together."""
    rows = counted.join(supports, ["shard", "lang_key"])
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.max(F.col("n") >= F.col("least")).alias("local"), *more).where(f"local and n >= {support}").drop("local")


def _named(rows: DataFrame, found: DataFrame, filters, scratch: Scratch, name: str, salt: Column, own: Column) -> DataFrame:
    """A pass of ``_names`` over ``rows``: what is ``found`` comes from the tasks whose ``salt`` is its ``own``."""
    keys = found.select(F.col("key").bitwiseXOR(own).alias("key"))
    owned = found.sparkSession.sparkContext.broadcast(Candidates.of(keys, found.count()))
    return scratch.keep(rows.withColumn("salt", salt).mapInArrow(_names(filters, owned), "lang string, key long, mark int, phrase string, n long"), name)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to LONGEST words with f >= support, and (lang, n), the words of a language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "phrases")
    lang = F.coalesce(docs[lang_col], F.lit(UNKNOWN_LANG))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), docs[text_col].alias("text"))
    filters, mined, supports = [], [], None
    for k in range(1, LONGEST + 1):
        counted = rows.mapInArrow(_local_counts(k, filters[-1] if filters else None), "task int, lang_key long, key long, mark int, n long")
        # Dealt by the key alone, so that a key's counts of all shards meet in one task.
        counted = counted.repartition("key").groupBy((F.col("task") % SHARDS).alias("shard"), "lang_key", "key", "mark").agg(F.sum("n").alias("n"), F.min("task").alias("owner"))
        if k == 1:
            counted = scratch.keep(counted, "words")
            supports = scratch.keep(_supports(counted.where("key is null"), support), "supports")
            if supports.count() <= BROADCAST_ROWS:
                supports = F.broadcast(supports)
        local = _candidates(counted.where("key is not null"), supports, support, ("key", "mark"), (F.min("owner").alias("owner"),))
        mined.append(scratch.keep(local, f"local{k}"))
        filters.append(spark.sparkContext.broadcast(Candidates.of(mined[-1], mined[-1].count())))
    found = reduce(DataFrame.union, mined)
    named = _named(rows, found, filters, scratch, "names", F.xxhash64(F.spark_partition_id()), F.xxhash64("owner"))
    words = named.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    named = named.where("phrase is not null").drop("n")
    left = found.join(named, ["key", "mark"], "left_anti")
    if not left.isEmpty():
        left = scratch.keep(left, "left")
        named = named.union(_named(rows, left, filters, scratch, "more_names", F.lit(0).cast("long"), F.lit(0).cast("long")).where("phrase is not null").drop("n"))
    counts = scratch.keep(found.join(named.dropDuplicates(["key", "mark"]), ["key", "mark"]).select("lang", "phrase", F.col("n").alias("f")), "counts")
    words = scratch.keep(words, "totals")
    scratch.free("words", "supports", "names", "left", "more_names", *(f"local{k}" for k in range(1, LONGEST + 1)))
    return counts, words


def _parts(phrase: str, first: str, size: str):
    return F.expr(f"array_join(slice(split({phrase}, ' '), {first}, {size}), ' ')")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Left out are phrases inside a longer candidate that has COVERED percent of their occurrences or more.
    """
    counts, words = frequent_phrases(docs, text_col, lang_col, support)
    sized = counts.withColumn("size", F.size(F.split("phrase", " "))).where("size > 1")
    longer = sized.where("size > 2").select("lang", "f", "size", "phrase", F.explode(F.expr("sequence(2, size - 1)")).alias("w"))
    longer = longer.select("lang", "f", "w", "phrase", F.explode(F.expr("sequence(1, size - w + 1)")).alias("at"))
    inside = longer.select("lang", _parts("phrase", "at", "w").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    big = lambda c: F.col(c).cast("decimal(20, 0)")
    left_over = sized.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (big("most") * 100 < big("f") * COVERED)).drop("most")
    cuts = left_over.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"))
    cuts = cuts.withColumns({"left": _parts("phrase", "1", "cut"), "right": _parts("phrase", "cut + 1", "size - cut")})
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(CLASSES)).alias("class"))
    place = "row_number() over (partition by {} order by score desc, a desc, phrase)"
    best = scored.withColumn("place", F.expr(place.format("lang, class"))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.expr(place.format("lang")).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
