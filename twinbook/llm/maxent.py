"""Language-model scores: hashed maximum entropy with a class-factored softmax.

A token's probability is P(class | history) * P(slot | class, history), two
softmaxes over sums of weights. Weights are rows of two tables; a row's place is
a hash of a feature of the history: the last word, the word before it (a skip)
and both. The slots of a class are its
most frequent words and one for all others, among which counts decide. Events
are all words of the training texts and, in each class, any other word; their
probabilities sum to one.

1. Words are counted over all training texts. The most frequent come back to the
   driver (a bounded table); what they lack is looked up by a join when scoring.
2. Classes: frequent words, and all others by their last letters, are clustered
   by their neighbours (k-means on a table of fixed size, counted over all texts).
3. Training: each text is read in one of ROUNDS rounds. In a round every task
   updates its own copy of the weights by AdaGrad on batches of its tokens; the
   changes are averaged by row, each weighed by how often the task met the row.
4. Scoring: sparse batches in numpy; sums per text.

Weights are floating-point sums whose order Spark does not fix: scores of two
runs agree to about five digits, base scores to the last few bits.

Edge cases: null and empty texts have one token, their end; a null id is trained
on; repeated rows count and are scored each; texts of any length are read whole;
an empty table gives an empty result, and without training texts every word has
the same chance; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, numbers, text_chunks
from .words import WordReader, byte_kinds

FOLDS = 10
#: Words whose counts every task knows; words that are units of their own; classes of last letters.
TABLE, UNITS, SUFFIXES = 1 << 18, 1 << 12, 1 << 12
CLASSES, SLOTS, CONTEXTS = 32, 32, 64
#: Rows of each table of weights, and of a block that travels on its own.
ROWS, BLOCK = 1 << 15, 256
ROUNDS, RATE, BATCH = 3, 0.25, 8192
#: Sums are cut here, so that no exponential overflows; segments up to this length are added place by place.
LARGEST, SHORT = np.float32(60), 16
ADDED = 0.1
#: Tokens that a task of the training reads at least, if there are enough tasks for all cores.
WORKER = 1 << 20
CHUNK = 1 << 19
#: Words that a task holds before it counts them together, and tasks' blocks are added in so many parts first.
HELD, PARTS = 1 << 20, 32
KINDS = byte_kinds(b" \t\n\x0b\x0c\r")
_END = np.array([10], np.uint8)  # no word has this byte
_NO_UNIT = UNITS + SUFFIXES
_NEVER = np.float32(-1e9)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


class HashIndex:
    """Places of 128-bit keys in a table, by open addressing."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        size = 1 << max(4, (4 * len(first)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        todo, place = np.arange(len(first)), (first & self.mask).astype(np.int64)
        while len(todo):
            free = todo[self.slots[place[todo]] < 0]
            self.slots[place[free]] = free
            todo = todo[self.slots[place[todo]] != todo]
            place[todo] = (place[todo] + 1) & (size - 1)

    def find(self, first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        """The place of each key, -1 for none."""
        place = (first & self.mask).astype(np.int64)
        found = self.slots[place]
        if not len(self.first):
            return found
        other = lambda at, i: (self.first[at] != first[i]) | (False if second is None else self.second[at] != second[i])
        open_ = np.flatnonzero((found >= 0) & other(found, slice(None)))
        while len(open_):
            place[open_] = (place[open_] + 1) & int(self.mask)
            found[open_] = now = self.slots[place[open_]]
            open_ = open_[(now >= 0) & other(now, open_)]
        return found


@dataclass
class Tokens:
    """Tokens of a chunk, the end of each text among them."""

    text: np.ndarray
    first: np.ndarray
    second: np.ndarray | None
    suffix: np.ndarray
    begin: np.ndarray  # of each text, and the end of the last


class TokenReader:
    """Reads tokens; with one hash there is no second, and looking a word up trusts the first."""

    def __init__(self, n_hashes: int = 2):
        self.words = WordReader(KINDS, n_hashes)
        self.end = [h[0] for h in self.words.hashes(_END, np.array([0]), np.array([1]))]

    def read(self, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        w, n = self.words.read(data, offsets), len(offsets) - 1
        at = np.arange(len(w.start)) + w.text
        before = np.searchsorted(w.text, np.arange(n + 1))
        begin = before + np.arange(n + 1)
        size, tail = w.end - w.start, np.zeros(len(w.start), np.uint64)
        for back in (1, 2, 3):
            tail = tail * np.uint64(256) + np.where(size >= back, w.data[np.maximum(w.end - back, 0)], 0).astype(np.uint64)
        texts, suffix = np.repeat(np.arange(n), np.diff(begin)), np.zeros(len(at) + n, np.int64)
        suffix[at] = (mix64(tail) & np.uint64(SUFFIXES - 1)).astype(np.int64)
        hashes = [np.full(len(at) + n, e, np.uint64) for e in self.end]
        for out, found in zip(hashes, w.hashes, strict=True):
            out[at] = found
        first, second = hashes if len(hashes) == 2 else (*hashes, None)
        return Tokens(texts, first, second, suffix, begin)


def _count(batches):
    """Maps batches of (text) to (first, second, suffix, n), counts of a task."""
    reader, held, size = TokenReader(), [], 0

    def out():
        first, second, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((second, first))
        edge = np.ones(len(order), bool)
        edge[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        begin = np.flatnonzero(edge)
        n, at = np.diff(np.append(begin, len(order))), order[begin]
        return pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), pa.array(suffix[at]), pa.array(n)], ["first", "second", "suffix", "n"])

    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
            t = reader.read(data, offsets)
            held.append((t.first, t.second, t.suffix))
            size += len(t.first)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class Vocabulary:
    """The frequent words: keys, counts, and which are units of their own."""

    def __init__(self, rows: np.ndarray):
        first, second, self.suffix, self.count = rows.T
        self.first, self.second = first.view(np.uint64), second.view(np.uint64)
        order = np.lexsort((self.second, self.first, -self.count))[:UNITS]
        self.unit = np.full(len(self.count), -1)
        self.unit[order] = np.arange(len(order))
        self.top = order

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table (-1: none) and unit of each token."""
        if "index" not in self.__dict__:
            self.index = HashIndex(self.first, self.second)
        place = self.index.find(t.first, t.second)
        unit = self.unit[place] if len(self.unit) else np.full(len(place), -1)
        return place, np.where((place >= 0) & (unit >= 0), unit, UNITS + t.suffix)


def _before(x: np.ndarray, t: Tokens, back: int, none: int) -> np.ndarray:
    """The value of the token ``back`` places earlier in the same text."""
    out = np.full(len(x), none, x.dtype)
    out[back:] = x[:-back] if back < len(x) else x[:0]
    out[np.arange(len(x)) - t.begin[t.text] < back] = none
    return out


def _neighbours(words):
    """Maps batches of (text) to blocks of a matrix (unit, neighbours in CONTEXTS classes before and after)."""

    def run(batches):
        reader, vocabulary = TokenReader(1), words.value
        matrix = np.zeros(_NO_UNIT * 2 * CONTEXTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                t = reader.read(data, offsets)
                _, unit = vocabulary.look_up(t)
                last = _before(unit, t, 1, _NO_UNIT)
                near = lambda x: (mix64(x.astype(np.uint64) + np.uint64(1)) % np.uint64(CONTEXTS)).astype(np.int64)
                matrix += np.bincount(unit * 2 * CONTEXTS + near(last), minlength=len(matrix))
                some = last != _NO_UNIT
                matrix += np.bincount(last[some] * 2 * CONTEXTS + CONTEXTS + near(unit[some]), minlength=len(matrix))
        for block, part in enumerate(np.split(matrix.astype(np.float32), _NO_UNIT // BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "data"])

    return run


def _added(rows: DataFrame, read, add, pack) -> DataFrame:
    """One row for each block: ``add`` folds what ``read`` makes of its rows' data, first in PARTS parts, then the parts.

    ``add(sum or None, item)`` returns the new sum, ``pack`` its bytes; a task holds one sum for each of its blocks.
    """

    def run(batches):
        sums = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = add(sums.get(block), read(data.as_buffer()))
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(total)], pa.binary())], ["block", "data"])

    part = F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(PARTS)).alias("part")
    for keys in (["block", "part"], ["block"]):
        rows = rows.select("block", "data", part).repartition(*keys).select("block", "data").mapInArrow(run, "block int, data binary")
    return rows


def _collected(rows: DataFrame, read) -> dict:
    """Blocks of a table of fixed size, on the driver."""
    return {r["block"]: read(r["data"]) for r in rows.toLocalIterator()}


def _floats(data) -> np.ndarray:
    return np.frombuffer(data, np.float32)


def _float_bytes(data: np.ndarray) -> bytes:
    return data.astype(np.float32).tobytes()


def _plus(total, data):
    return data.astype(np.float64) if total is None else total + data


def cluster(matrix: np.ndarray, classes: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Class of each row by k-means on the square roots of its shares; rows weigh as they count, rows without counts go to class 0."""
    weight = matrix.sum(axis=1)
    x = np.sqrt(matrix / np.maximum(weight, 1)[:, None])
    x[weight > 0] -= np.average(x[weight > 0], axis=0, weights=weight[weight > 0]) if weight.any() else 0
    rng, found = np.random.default_rng(seed), np.zeros(len(x), np.int64)
    if not weight.any():
        return found
    weight = np.sqrt(weight)
    centre = x[rng.choice(len(x), 1, p=weight / weight.sum())]
    far = ((x - centre[0]) ** 2).sum(axis=1)
    for _ in range(classes - 1):
        p = far * weight
        if not p.sum() > 1e-9:
            break
        centre = np.vstack([centre, x[rng.choice(len(x), 1, p=p / p.sum())]])
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        found = ((centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        total = np.bincount(found, weight, minlength=len(centre))
        for c in np.flatnonzero(total):
            centre[c] = weight[found == c] @ x[found == c] / total[c]
    found[matrix.sum(axis=1) == 0] = 0
    return found


class Model:
    """Classes, slots and weights."""

    def __init__(self, words: Vocabulary, unit_class: np.ndarray, suffix_counts: np.ndarray):
        """``suffix_counts``: occurrences and number of all words of each class of last letters."""
        self.words, self.unit_class = words, unit_class
        count = words.count[words.top]
        rest = suffix_counts.astype(np.float64).copy()
        np.subtract.at(rest[:, 0], words.suffix[words.top], count)
        np.subtract.at(rest[:, 1], words.suffix[words.top], 1)
        self.unit_slot = np.full(_NO_UNIT, SLOTS - 1)
        slot_count = np.zeros((CLASSES, SLOTS))
        of_class = unit_class[: len(count)]
        for c in range(CLASSES):
            mine = np.flatnonzero(of_class == c)
            heads, others = mine[: SLOTS - 1], mine[SLOTS - 1 :]
            self.unit_slot[heads] = np.arange(len(heads))
            slot_count[c, : len(heads)] = count[heads]
            slot_count[c, -1] = count[others].sum() + rest[unit_class[UNITS:] == c, 0].sum()
        kinds = np.bincount(of_class[self.unit_slot[: len(count)] == SLOTS - 1], minlength=CLASSES)
        kinds = kinds + np.bincount(unit_class[UNITS:], rest[:, 1], minlength=CLASSES)
        #: What a word outside the slots is divided by, in each class.
        self.rest = slot_count[:, -1] + ADDED * (kinds + 1)
        self.weights = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32)]
        self.met = [np.full(ROWS, 1e-2, np.float32) for _ in self.weights]
        share = slot_count.sum(axis=1) + 1
        self.weights[0][0] = np.log(share / share.sum())
        slots = np.where(slot_count > 0, slot_count, 0)
        slots[:, -1] += 1
        with np.errstate(divide="ignore"):
            self.weights[1][:CLASSES] = np.where(slots > 0, np.log(slots / slots.sum(axis=1, keepdims=True)), _NEVER)

    def rows(self, t: Tokens, unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For both softmaxes the rows of each token's features (the first is the bias), its class and slot."""
        target, slot = self.unit_class[unit], self.unit_slot[unit]
        one, two, three = (_before(unit, t, k, _NO_UNIT).astype(np.uint64) for k in (1, 2, 3))
        wide = np.uint64(1 << 14)
        features = [one, two | wide << np.uint64(14), (one * wide + two) | np.uint64(1 << 30)]
        inner = (target.astype(np.uint64) + np.uint64(1)) << np.uint64(34)
        found = []
        for bias, salt in ((np.zeros(len(unit), np.uint16), np.uint64(0)), (target.astype(np.uint16), inner)):
            # The product's upper half, scaled to the rows behind the biases.
            places = [(((((f | salt) * _SPREAD) >> np.uint64(32)) * np.uint64(ROWS - CLASSES)) >> np.uint64(32)).astype(np.uint16) + np.uint16(CLASSES) for f in features]
            found.append(np.stack([bias, *places]))
        return found, target, slot

    @staticmethod
    def forward(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of each token's weights (cut at LARGEST), their exponentials and the exponentials' totals."""
        sums = weights.take(rows[0], axis=0)
        part = np.empty_like(sums)
        for r in rows[1:]:
            sums += weights.take(r, axis=0, out=part, mode="clip")
        np.minimum(sums, LARGEST, out=sums)
        powers = np.exp(sums, out=part)
        return sums, powers, powers @ np.ones(powers.shape[1], np.float32)

    def log_chance(self, rows: list[np.ndarray], targets: tuple[np.ndarray, ...]) -> np.ndarray:
        """Natural logarithm of P(class | history) * P(slot | class, history)."""
        out = np.zeros(rows[0].shape[1])
        for lo in range(0, len(out), BATCH):
            hi = lo + BATCH
            for weights, r, target in zip(self.weights, rows, targets, strict=True):
                sums, _, total = self.forward(weights, r[:, lo:hi])
                out[lo:hi] += sums[np.arange(len(sums)), target[lo:hi]] - np.log(total)
        return out

    def learn(self, which: int, rows: np.ndarray, target: np.ndarray, counts: np.ndarray) -> None:
        """One AdaGrad step on a batch; ``counts`` gathers how often rows are met."""
        weights, met = self.weights[which], self.met[which]
        _, grad, total = self.forward(weights, rows)
        grad /= total[:, None]
        grad[np.arange(len(grad)), target] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        edge = np.ones(len(flat), bool)
        edge[1:] = np.diff(flat[order]) != 0
        begin = np.flatnonzero(edge)
        row, n = flat[order[begin]], np.diff(np.append(begin, len(flat)))
        token = np.tile(np.arange(len(target)), len(rows))[order]
        step = _segment_sums(grad, token, begin, n)
        size = met[row] + np.einsum("ij,ij->i", step, step) / np.float32(step.shape[1])
        step *= (np.float32(RATE) / np.sqrt(size))[:, None]
        now = weights.take(row, axis=0)
        now -= step
        # Rows as single items are written at once.
        item = np.dtype((np.void, now.strides[0]))
        np.put(weights.view(item), row, now.view(item))
        met[row] = size
        counts[row] += n


def _segment_sums(rows: np.ndarray, order: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order[begin : begin + n]`` of each segment: short segments place by place, long ones each on its own."""
    out = rows.take(order[begin], axis=0)
    for k in np.flatnonzero(n > SHORT):
        out[k] = rows.take(order[begin[k] : begin[k] + n[k]], axis=0).sum(axis=0)
    more = np.flatnonzero((n > 1) & (n <= SHORT))
    for place in range(1, SHORT):
        if not len(more):
            break
        out[more] += rows.take(order[begin[more] + place], axis=0)
        more = more[n[more] > place + 1]
    return out


def _train(model):
    """Maps batches of (text) to blocks of changes: change * n, met * n and n of each row, of a task."""

    def run(batches):
        start = model.value
        own = Model.__new__(Model)
        own.__dict__.update(start.__dict__)
        own.weights, own.met = [w.copy() for w in start.weights], [m.copy() for m in start.met]
        reader, counts = TokenReader(1), [np.zeros(ROWS, np.float32) for _ in own.weights]
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                t = reader.read(data, offsets)
                _, unit = own.words.look_up(t)
                rows, *targets = own.rows(t, unit)
                for lo in range(0, len(unit), BATCH):
                    for i in (0, 1):
                        own.learn(i, rows[i][:, lo : lo + BATCH], targets[i][lo : lo + BATCH], counts[i])
        for i in (0, 1):
            for b in range(ROWS // BLOCK):
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                n = counts[i][at]
                if n.any():
                    block = [own.weights[i][at] - start.weights[i][at], own.met[i][at], n]
                    yield pa.RecordBatch.from_arrays([pa.array([i * (ROWS // BLOCK) + b], pa.int32()), pa.array([_change_bytes(block)], pa.binary())], ["block", "data"])

    return run


def _change(data) -> list[np.ndarray]:
    """A block's change, met and n of each row, from bytes."""
    numbers_, halves = np.frombuffer(data, np.float32, 2 * BLOCK), np.frombuffer(data, np.float16, offset=8 * BLOCK)
    return [halves.reshape(BLOCK, -1).astype(np.float32), numbers_[:BLOCK].copy(), numbers_[BLOCK:].astype(np.float64)]


def _change_bytes(block: list[np.ndarray]) -> bytes:
    change, met, n = block
    return np.concatenate([met, n]).astype(np.float32).tobytes() + change.astype(np.float16).tobytes()


def _mean(total, block):
    """Folds blocks into their mean, each row by its n."""
    if total is None:
        return block
    n = total[2] + block[2]
    share = (block[2] / np.maximum(n, 1)).astype(np.float32)
    return [total[0] + (block[0] - total[0]) * share[:, None], total[1] + (block[1] - total[1]) * share, n]


def _score(model):
    """Maps batches of (id, held_out, row, text) to sums per text and the words that the table lacks."""

    def run(batches):
        m, reader = model.value, TokenReader()
        log_count, log_rest = np.log(m.words.count + ADDED), np.log(m.rest)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(3), CHUNK):
                t = reader.read(data, offsets)
                place, unit = m.words.look_up(t)
                rows, target, slot = m.rows(t, unit)
                chance = m.log_chance(rows, (target, slot))
                known, other = place >= 0, slot == SLOTS - 1
                count = np.where(known, log_count[place] if len(log_count) else 0.0, 0.0)
                chance += np.where(other, count - log_rest[target], 0.0)
                sums = [np.add.reduceat(x, t.begin[:-1]) for x in (known.astype(np.int64), count, chance)]
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((t.second[rare], t.first[rare], t.text[rare]))]
                edge = np.ones(len(order), bool)
                edge[1:] = (np.diff(t.text[order]) != 0) | (np.diff(t.first[order]) != 0) | (np.diff(t.second[order]) != 0)
                begin = np.flatnonzero(edge)
                times, at = np.diff(np.append(begin, len(order))), order[begin]
                lists = np.searchsorted(t.text[at], np.arange(hi - lo + 1)).astype(np.int32)
                listed = lambda x, lists=lists: pa.ListArray.from_arrays(lists, pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(np.diff(t.begin)), *map(pa.array, sums), listed(t.first[at].view(np.int64)), listed(t.second[at].view(np.int64)), listed(times)],
                    ["id", "held_out", "row", "n_tokens", "known", "base", "score", "first", "second", "times"],
                )

    return run


def _frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The words of the largest counts, ``most`` at the most, those of one count together."""
    histogram = numbers(counts.groupBy("n").agg(F.count("*").alias("words")))
    histogram = histogram[np.argsort(-histogram[:, 0])]
    fits = np.flatnonzero(np.cumsum(histogram[:, 1]) <= most)
    if not len(fits):
        return np.zeros((0, 4), np.int64)
    return numbers(counts.where(F.col("n") >= int(histogram[fits[-1], 0])).select("first", "second", "suffix", "n"))


def fit(texts: DataFrame, counts: DataFrame, total: int) -> Model:
    """Classes and weights from training ``texts`` (id, text), their ``counts`` and the ``total`` of these."""
    context = texts.sparkSession.sparkContext
    words = Vocabulary(_frequent(counts, TABLE))
    by_suffix = numbers(counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("words")))
    suffix_counts = np.zeros((SUFFIXES, 2), np.int64)
    suffix_counts[by_suffix[:, 0]] = by_suffix[:, 1:]
    sent = context.broadcast(words)
    matrix = np.zeros((_NO_UNIT, 2 * CONTEXTS), np.float32)
    workers = lambda turns: max(context.defaultParallelism, -(-total // turns // WORKER))
    matrices = texts.select("text").coalesce(workers(1)).mapInArrow(_neighbours(sent), "block int, data binary")
    for b, data in _collected(_added(matrices, _floats, _plus, _float_bytes), _floats).items():
        matrix.ravel()[b * len(data) : (b + 1) * len(data)] = data
    sent.destroy()
    model = Model(words, cluster(matrix, CLASSES), suffix_counts)
    turn = F.pmod(F.xxhash64("id"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        sent = context.broadcast(model)
        changes = texts.where(turn == r).select("text").coalesce(workers(ROUNDS)).mapInArrow(_train(sent), "block int, data binary")
        for b, (change, met, n) in _collected(_added(changes, _change, _mean, _change_bytes), _change).items():
            which, at = divmod(b, ROWS // BLOCK)
            at = slice(at * BLOCK, (at + 1) * BLOCK)
            model.weights[which][at] += change
            model.met[which][at] = np.where(n > 0, met, model.met[which][at])
        sent.destroy()
    return model


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "maxent")
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    training = rows.where(~F.col("held_out")).select("id", "text")
    counts = training.select("text").mapInArrow(_count, "first long, second long, suffix long, n long")
    counts = scratch.keep(counts.groupBy("first", "second").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = fit(training, counts, total["n"])
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, row long, n_tokens long, known long, base double, score double, first array<long>, second array<long>, times array<long>"
    numbered = rows.select("id", "held_out", F.monotonically_increasing_id().alias("row"), "text")
    scored = scratch.keep(numbered.mapInArrow(_score(spark.sparkContext.broadcast(model)), kind), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("first", "second", "times")).alias("w")).select("row", "w.first", "w.second", "w.times")
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(counts.select("first", "second", "n"), ["first", "second"], "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log(c + F.lit(ADDED))).alias("log"))
    out = scored.drop("first", "second", "times").join(rare, "row", "left")
    log, ten = F.coalesce("log", F.lit(0.0)), float(np.log(10))
    each = float(np.log10(total["n"] + ADDED * (total["v"] + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        ((F.col("base") + log) / ten - F.col("n_tokens") * each).alias("base_score"), ((F.col("score") + log) / ten).alias("score"),
    )
