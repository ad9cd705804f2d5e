"""SentencePiece encoding and decoding in numpy, many words at a time.

Texts are cut into units (a run of spaces and the word behind it; no piece
reaches over a unit). A worker encodes each distinct unit once, by Viterbi:
units of equal length advance together, place by place; the hashes of all
substrings that end at the place probe the sorted piece keys, and vectorised
maxima keep backpointers. In a unigram model the best sum of scores wins. A BPE
model joins pairs in the order of their scores instead, which no sum gives; but
its result is the one path in which each piece is what joining makes of its own
characters, and each two neighbours what joining makes of theirs. So a piece
counts only if it may follow the last piece of the path that it extends; that is
tried once for each pair of pieces, by joining their characters.

Edge cases: a null text gives null ids, null ids a null text; an empty text has
no ids; texts and units of any length are read whole (long units of similar
length advance together); characters without a piece become byte pieces, or
unknown; decoding replaces bytes that are not UTF-8; repeated rows are encoded
alike; an empty table gives an empty result; an existing column of the output's
name is replaced, all others pass by. The model file is read once, by the driver.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64

SPACE = "▁"
LONG = 64  # longest unit that advances beside units of its own length only
_FILL = 0x10FFFF  # fills shorter units up; no character
_START, _LONE = -1, -2
#: Bits of the tables that are read in place of a search.
SLOTS = 20
#: Ids of units that a worker remembers (32 MB), before it begins anew.
UNIT_IDS = 1 << 23
#: Pairs of pieces that a worker remembers.
REMEMBERED = 1 << 21
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class PieceModel:
    """Pieces, scores and settings of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], unigram: bool, dummy_prefix: bool):
        self.pieces, self.unigram, self.dummy_prefix = pieces, unigram, dummy_prefix
        self.scores, self.types = np.array(scores, np.float64), np.array(types)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are read")
        if train.model_type not in (1, 2) or any(p.type == 4 for p in model.pieces):
            raise ValueError("only unigram and BPE models without user symbols are read")
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
            raise ValueError("a piece has a space after its first word")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], train.model_type == 1, norm.add_dummy_prefix)

    def __reduce__(self):
        """A worker keeps one model for all its tasks, with the tables that it has made."""
        fields = (self.pieces, self.scores.tolist(), self.types.tolist(), self.unigram, self.dummy_prefix)
        return _kept_model, (hashlib.sha1(repr(fields).encode()).hexdigest(), fields)

    # Symbols: all pieces by id, then single characters of pieces that are none themselves.
    @cached_property
    def _normal(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.types[i] == _NORMAL}

    @cached_property
    def _symbols(self) -> dict[str, int]:
        out = dict(self._normal)
        for c in sorted({c for p in self._normal for c in p}):
            out.setdefault(c, len(self.pieces) + len(out))
        return out

    @cached_property
    def _of_char(self) -> np.ndarray:
        """Symbol of a code point, -1 for none."""
        out = np.full(0x110000, -1, np.int64)
        for p, i in self._symbols.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted keys of adjacent symbols that join to a piece, the pieces, and the key's base."""
        base = max(self._symbols.values()) + 2
        table = {}
        for p, i in self._normal.items():
            for k in range(1, len(p)):
                a, b = self._symbols.get(p[:k]), self._symbols.get(p[k:])
                if a is not None and b is not None:
                    table[a * base + b] = i
        keys = np.array(sorted(table), np.int64)
        return keys, np.array([table[k] for k in keys.tolist()], np.int64), base

    @cached_property
    def _chars(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all symbols, concatenated, and each symbol's begin and length."""
        size, begin = np.zeros(max(self._symbols.values()) + 1, np.int64), np.zeros(max(self._symbols.values()) + 1, np.int64)
        at = 0
        for p, i in self._symbols.items():
            size[i], begin[i] = len(p), at
            at += len(p)
        return np.array([ord(c) for p in self._symbols for c in p], np.int64), begin, size

    def _spread(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of the characters of rows of symbols, which have equal lengths in sum."""
        chars, begin, size = self._chars
        n = size[symbols].ravel()
        before = np.cumsum(n) - n
        return chars[np.repeat(begin[symbols].ravel() - before, n) + np.arange(n.sum())].reshape(len(symbols), -1)

    @cached_property
    def _keys(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted substring hashes of the pieces, their ids, and the longest piece's length.

        Of a BPE model, those that joining makes of their own characters, and the single characters.
        """
        names, ids = zip(*(self._normal if self.unigram else self._symbols).items(), strict=True)
        ids = np.array(ids, np.int64)
        hashes = np.array([_hash_text(p) for p in names], np.uint64)
        if not self.unigram:
            size = self._chars[2][ids]
            made = np.zeros(len(ids), bool)
            for n in np.unique(size):
                of = np.flatnonzero(size == n)
                made[of] = (self._merge(self._spread(ids[of, None]))[:, 1:] == -1).all(1)
            hashes, ids = hashes[made], ids[made]
        by = np.argsort(hashes)
        return hashes[by], ids[by], max(map(len, self._normal))

    @cached_property
    def _there(self) -> np.ndarray:
        """Which first SLOTS bits the keys have."""
        out = np.zeros(1 << SLOTS, bool)
        out[(self._keys[0] >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
        return out

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether joining the characters of both symbols gives just these two."""
        base = len(self._chars[2])
        key = left * base + right
        slot = ((key.astype(np.uint64) * np.uint64(_P)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        recent, answer = self.__dict__.setdefault("_recent", (np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)))
        out = answer[slot]
        late = np.flatnonzero(recent[slot] != key)
        if len(late):
            out[late] = self._looked_up(key[late], base)
            recent[slot[late]], answer[slot[late]] = key[late], out[late]
        return out

    def _looked_up(self, key: np.ndarray, base: int) -> np.ndarray:
        """``_follows`` from the table of all pairs that were tried, which grows by those that were not."""
        known, yes = self.__dict__.setdefault("_known", (np.zeros(0, np.int64), np.zeros(0, bool)))
        at = np.searchsorted(known, key)
        missing = key if not len(known) else key[known[at.clip(max=len(known) - 1)] != key]
        if len(missing):
            if len(known) > REMEMBERED:
                known, yes, missing = known[:0], yes[:0], key
            new = np.sort(missing)
            new = new[np.append(True, new[1:] != new[:-1])]
            pair = np.stack([new // base, new % base], axis=1)
            size = self._chars[2][pair]
            ok = np.zeros(len(new), bool)
            for n in np.unique(size.sum(1)):
                of = np.flatnonzero(size.sum(1) == n)
                starts = self._merge(self._spread(pair[of])) != -1
                ok[of] = (starts.sum(1) == 2) & starts[np.arange(len(of)), size[of, 0]]
            at = np.searchsorted(known, new)
            known, yes = self.__dict__["_known"] = np.insert(known, at, new), np.insert(yes, at, ok)
            at = np.searchsorted(known, key)
        return yes[at]

    @cached_property
    def _bytes(self) -> np.ndarray | None:
        """Ids of the 256 byte pieces."""
        ids = np.flatnonzero(self.types == _BYTE)
        return ids if len(ids) == 256 else None

    @cached_property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.types == _UNKNOWN)[0])

    def _spell(self, char: int) -> list[int]:
        """Ids of a character without a piece."""
        if self._bytes is None:
            return [self.unknown]
        return self._bytes[list(chr(char).encode("utf-8", "surrogatepass"))].tolist()

    # Units of equal length, a row each (shorter ones filled up); both return the id of the piece that starts at each
    # place, -1 inside a piece, -2 for a character without one.
    def _viterbi(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, length = chars.shape
        keys, ids, longest = self._keys
        there = self._there
        powers = _powers(_P, length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[:length], axis=1, out=sums[:, 1:])
        down = _powers(_P_INV, length + 1)
        best = np.zeros((n, length + 1))
        back, took = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), _START)
        worst = self.scores[self.types == _NORMAL].min() - 10.0  # as the library scores the unknown
        rows = np.arange(n)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - longest), end)
            h = mix64((sums[:, end, None] - sums[:, starts]) * down[starts] + (end - starts).astype(np.uint64))
            # Most substrings fall where no key is.
            r, c = np.nonzero(there[(h >> np.uint64(64 - SLOTS)).astype(np.int64)])
            found = h[r, c]
            place = np.searchsorted(keys, found).clip(max=len(keys) - 1)
            real = keys[place] == found
            r, c, place = r[real], c[real], place[real]
            hit, at = np.zeros(h.shape, bool), np.zeros(h.shape, np.int64)
            hit[r, c], at[r, c] = True, place
            if self.unigram:
                value = np.where(hit, best[:, starts] + self.scores[ids[at]], -np.inf)
                value[:, -1] = np.where(hit[:, -1], value[:, -1], best[:, end - 1] + worst)
            else:
                left, right = took[r, starts[c]], ids[place]
                inner = left >= 0
                hit[r[inner], c[inner]] = self._follows(left[inner], right[inner])
                value = np.where(hit, 0.0, -np.inf)
                value[:, -1] = np.maximum(value[:, -1], -1.0)  # a character without a piece
            k = value.argmax(1)
            best[:, end], back[:, end] = value[rows, k], starts[k]
            took[:, end] = np.where(hit[rows, k], ids[at[rows, k]], _LONE)
        out = np.full((n, length), -1)
        end = lengths.copy()
        while (live := end > 0).any():
            r, e = rows[live], end[live]
            out[r, back[r, e]] = np.where(took[r, e] < len(self.pieces), took[r, e], _LONE)
            end[live] = back[r, e]
        return out

    def _merge(self, chars: np.ndarray) -> np.ndarray:
        n, length = chars.shape
        keys, joined, base = self._pairs
        symbol = self._of_char[chars]
        follow = np.tile(np.arange(1, length + 1), (n, 1))  # place of the next symbol
        live = np.arange(n)
        out = symbol.copy()
        while len(live):
            s, nxt = symbol[live], follow[live]
            right = np.where(nxt < length, np.take_along_axis(s, np.minimum(nxt, length - 1), 1), -1)
            ok = (s >= 0) & (right >= 0)
            key = np.where(ok, s * base + right, -1)
            at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
            score = np.where(keys[at] == key, self.scores[joined[at]], -np.inf)
            k = score.argmax(1)
            more = score[np.arange(len(live)), k] > -np.inf
            live, k, at = live[more], k[more], at[more]
            gone = follow[live, k]
            symbol[live, k] = joined[at[np.arange(len(live)), k]]
            follow[live, k] = follow[live, gone]
            symbol[live, gone] = -3  # inside a piece
        out = symbol
        return np.where(out == -3, -1, np.where((out < 0) | (out >= len(self.pieces)), -2, out))

    def _encode_units(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, concatenated, and the number of ids of each."""
        places = np.full(int(length.sum()), -1)
        base = np.concatenate([[0], np.cumsum(length)])
        level = np.where(length <= LONG, length, LONG + np.ceil(np.log(np.maximum(length, 1) / LONG) * 8).astype(np.int64))
        for k in np.unique(level):
            which = np.flatnonzero(level == k)
            n = int(length[which].max())
            step = max(1, (1 << 19) // n)
            for i in range(0, len(which), step):
                part = which[i : i + step]
                own = np.arange(n) < length[part][:, None]
                grid = np.full((len(part), n), _FILL, np.int64)
                grid[own] = chars[(start[part][:, None] + np.arange(n))[own]]
                places[(base[part][:, None] + np.arange(n))[own]] = self._viterbi(grid, length[part])[own]
        unit = np.repeat(np.arange(len(length)), length)
        lone = np.flatnonzero(places == -2)
        size = (places != -1).astype(np.int64)
        spelled = {int(i): self._spell(int(chars[start[unit[i]] + i - base[unit[i]]])) for i in lone}
        for i, ids in spelled.items():
            size[i] = len(ids)
        flat = np.repeat(places, size)
        ends = np.cumsum(size)
        for i, ids in spelled.items():
            flat[ends[i] - len(ids) : ends[i]] = ids
        return flat, np.bincount(unit, size, len(length)).astype(np.int64) if len(unit) else np.zeros(len(length), np.int64)

    def _units(self, names: np.ndarray, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of units (of ascending names) lie among all that this worker has encoded, and how many they are."""
        empty = np.zeros(0, np.int64)
        known, begin, count, flat = self.__dict__.get("_encoded", (np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.int32)))
        if len(flat) > UNIT_IDS:
            known, begin, count, flat = known[:0], begin[:0], count[:0], flat[:0]
        at = np.searchsorted(known, names)
        new = np.ones(len(names), bool) if not len(known) else known[at.clip(max=len(known) - 1)] != names
        if new.any():
            ids, n = self._encode_units(chars, start[new], length[new])
            begin = np.insert(begin, at[new], len(flat) + np.cumsum(n) - n)
            known, count, flat = np.insert(known, at[new], names[new]), np.insert(count, at[new], n), np.concatenate([flat, ids.astype(np.int32)])
            at = np.searchsorted(known, names)
        self.__dict__["_encoded"] = known, begin, count, flat
        return begin[at], count[at]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text."""
        full = [((" " if self.dummy_prefix else "") + t).replace(" ", SPACE) if t else "" for t in texts]
        size = np.array([len(t) for t in full], np.int64)
        chars = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(size)])
        first = np.zeros(len(chars), bool)
        first[edges[:-1][size > 0]] = True
        space = chars == ord(SPACE)
        first[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(chars)))
        if len(start):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(chars)))])
            h = mix64((sums[start + length] - sums[start]) * _powers(_P_INV, len(chars))[start] + length.astype(np.uint64))
            _, one, back = np.unique(h, return_index=True, return_inverse=True)
            begin, count = self._units(h[one], chars, start[one], length[one])
            n = count[back]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.__dict__["_encoded"][3][np.repeat(begin[back] - total[:-1], n) + np.arange(total[-1])]
            offsets = total[np.searchsorted(start, edges)]
        else:
            ids, offsets = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        mask = pa.array([t is None for t in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=mask)

    @cached_property
    def _spellings(self) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all pieces, concatenated, and where each begins."""
        parts = [
            bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() if k == _NORMAL else " ⁇ ".encode() if k == _UNKNOWN else b""
            for p, k in zip(self.pieces, self.types.tolist(), strict=True)
        ]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The texts that ids stand for."""
        data, begin = self._spellings
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        n = begin[ids + 1] - begin[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        raw = data[np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        ends = total[offsets - offsets[0]]
        out = []
        for i, null in enumerate(lists.is_null().to_pylist()):
            text = raw[ends[i] : ends[i + 1]].decode("utf-8", "replace")
            out.append(None if null else text[1:] if self.dummy_prefix and text[:1] == " " else text)
        return out


_models: dict[str, PieceModel] = {}


def _kept_model(key: str, fields: tuple) -> PieceModel:
    if key not in _models:
        _models[key] = PieceModel(*fields)
    return _models[key]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash_text(text: str) -> np.uint64:
    chars = np.array([ord(c) for c in text], np.uint64)
    total = ((chars + np.uint64(1)) * _powers(_P, len(chars))).sum(keepdims=True)
    return mix64(total + np.uint64(len(chars)))[0]


def encode_column(rows: DataFrame, model: PieceModel, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``rows`` with the ids of a text column; a column named ``out`` is replaced."""
    return _mapped(rows, out, "array<int>", text_col, lambda column: model.encode(column.to_pylist()))


def decode_column(rows: DataFrame, model: PieceModel, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column; a column named ``out`` is replaced."""
    return _mapped(rows, out, "string", ids_col, lambda column: pa.array(model.decode(column), pa.string()))


def _mapped(rows: DataFrame, out: str, kind: str, source: str, f) -> DataFrame:
    bounded_batches(rows.sparkSession)
    others = [F.col(f"`{c}`") for c in rows.columns if c != out]
    rows = rows.select(F.col(f"`{source}`").alias("source"), F.struct(*others, F.lit(None).cast("int").alias("")).alias("row"))
    schema = rows.select("row", F.lit(None).cast(kind).alias("made")).schema

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), f(batch.column(0))], ["row", "made"])

    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in rows.select("row.*").columns[:-1]], F.col("made").alias(out))
