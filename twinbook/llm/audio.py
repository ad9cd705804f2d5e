"""Audio media columns: lossless 8-bit samples, and features of them.

Media is a RIFF/WAVE file in a binary column (mono, 8-bit unsigned PCM). The
features of a clip are log-mel filterbank patches of fixed shape, each with its
time span, and the segments whose energy stays up under hysteresis. Samples are
first resampled by a polyphase filter; frames overlap by half.

Edge cases: null media gives null features; a clip without samples has no
patches and no segments; silence has no segments; the last patch is padded with
the floor value, and its span ends with the clip. Long clips are filtered and
framed in pieces of PIECE samples; what grows with a clip are its features, less
than a byte for each of its samples.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, UP, DOWN, TAPS = 8000, 2, 3, 8
FRAME, HOP, BANDS, PATCH = 128, 64, 16, 32
FLOOR = 1e-6
#: A segment opens when a frame's log energy exceeds the clip's median by OPEN
#: and closes when it falls below the median by CLOSE.
OPEN, CLOSE = 0.15, 0.05
PIECE = 1 << 16  # resampled samples that are framed at a time


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as a WAVE file (padded to even length, as RIFF asks)."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\x80" * (n % 2)


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of an 8-bit mono WAVE file, found by walking its chunks."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _low_pass() -> np.ndarray:
    """Windowed-sinc filter in UP phases, each of unit sum and in the order of the samples that it weighs."""
    n = -(-TAPS * max(UP, DOWN) // UP) * UP
    t = (np.arange(n) - (n - 1) // 2) / max(UP, DOWN)
    h = np.sinc(t) * np.hanning(n + 2)[1:-1]
    phases = np.stack([h[p::UP][::-1] for p in range(UP)])
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    lo, mid, hi = points[:-2, None], points[1:-1, None], points[2:, None]
    up, down = (freq - lo) / (mid - lo), (hi - freq) / (hi - mid)
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_FILTER, _BANK = _low_pass(), _mel_bank(RATE * UP / DOWN)
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Rational resampling by UP/DOWN: output i weighs the samples around i * DOWN / UP by one of the filter's phases."""
    taps = _FILTER.shape[1]
    n = -(-len(x) * UP // DOWN)
    pad = np.concatenate([np.zeros(taps, np.float32), x, np.zeros(2 * taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(pad, taps)
    out = np.empty(n, np.float32)
    for first in range(min(UP, n)):  # outputs first, first + UP, ... have one phase; their windows are DOWN samples apart
        base, phase = divmod(first * DOWN + (taps * UP - 1) // 2, UP)
        count = len(range(first, n, UP))
        out[first::UP] = windows[base + 1 :: DOWN][:count] @ _FILTER[phase]
    return out


def _resampled_piece(x: np.ndarray, at: int) -> np.ndarray:
    """Resampled audio of PIECE * DOWN samples from ``at``, with their neighbours on both sides in the filter's reach."""
    reach = TAPS * DOWN * 2
    lo = max(0, at - reach)
    out = resample(x[lo : at + PIECE * DOWN + reach].astype(np.float32) / 128 - 1)
    skip = (at - lo) * UP // DOWN
    return out[skip : skip + -(-min(PIECE * DOWN, len(x) - at) * UP // DOWN)]


def log_mel(pieces) -> np.ndarray:
    """(frames, BANDS) log-mel energies of resampled audio, which comes in pieces; the last frame is padded with silence."""
    out, held, started = [], np.zeros(0, np.float32), False
    for x, last in pieces:
        held = np.concatenate([held, x])
        if last and len(held) and (not started or len(held) > FRAME - HOP):
            n = max(1, -(-(len(held) - FRAME) // HOP) + 1)
            held = np.concatenate([held, np.zeros(max(0, (n - 1) * HOP + FRAME - len(held)), np.float32)])
        n = (len(held) - FRAME) // HOP + 1
        if n > 0:
            frames = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP][:n]
            spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
            out.append(np.log((spectrum.real**2 + spectrum.imag**2) @ _BANK + FLOOR).astype(np.float32))
            held, started = held[n * HOP :], True
    return np.concatenate([np.zeros((0, BANDS), np.float32), *out])


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame runs [start, end) that open above the upper and close below the lower threshold."""
    if not len(energy):
        return []
    middle = np.median(energy)
    mark = np.where(energy > middle + OPEN, 1, np.where(energy < middle - CLOSE, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = (last >= 0) & (mark[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


FEATURES = T.StructType(
    [
        T.StructField("seconds", T.DoubleType()),
        T.StructField("frames", T.IntegerType()),
        T.StructField(
            "patches",
            T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("values", T.ArrayType(T.FloatType()))])),
        ),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
    ]
)


def clip_features(media: bytes) -> dict:
    """Features of one WAVE file, as in FEATURES; a patch holds PATCH x BANDS values, frame by frame."""
    rate, samples = from_wav(media)
    x = np.frombuffer(samples, np.uint8)
    mel = log_mel((_resampled_piece(x, at), at + PIECE * DOWN >= len(x)) for at in range(0, len(x), PIECE * DOWN))
    out_rate, seconds = rate * UP / DOWN, len(x) / rate
    time = lambda frame: min(seconds, frame * HOP / out_rate)
    n = -(-len(mel) // PATCH)
    padded = np.full((n * PATCH, BANDS), np.log(FLOOR), np.float32)
    padded[: len(mel)] = mel
    return {
        "seconds": seconds, "frames": len(mel),
        "patches": [{"start": time(k * PATCH), "end": seconds if k == n - 1 else time((k + 1) * PATCH), "values": padded[k * PATCH : (k + 1) * PATCH].ravel()} for k in range(n)],
        "segments": [{"start": time(a), "end": time(b)} for a, b in segments(mel.mean(1))],
    }


@F.pandas_udf(T.BinaryType())
def wav_of_text(text: pd.Series) -> pd.Series:
    """A text's UTF-8 bytes, filled with spaces to a positive multiple of 192, as WAVE media; null counts as empty."""

    def pack(t):
        b = (t or "").encode()
        return to_wav(b.ljust(max(1, -(-len(b) // 192)) * 192, b" "))

    return pd.Series([pack(t) for t in text], dtype=object)


@F.pandas_udf(T.BinaryType())
def samples_of(media: pd.Series) -> pd.Series:
    """The samples stored in WAVE media, byte for byte."""
    return pd.Series([None if m is None else bytes(from_wav(m)[1]) for m in media], dtype=object)


@F.pandas_udf(FEATURES)
def audio_features(media: pd.Series) -> pd.DataFrame:
    """Struct FEATURES of a media column."""
    rows = [dict.fromkeys(FEATURES.names) if m is None else clip_features(m) for m in media]
    return pd.DataFrame(rows, columns=FEATURES.names)


def patch_tensor(values) -> pa.FixedShapeTensorArray:
    """Stored patches (bytes each) as an Arrow tensor column of shape (PATCH, BANDS), for example to write them to a file."""
    kind = pa.fixed_shape_tensor(pa.uint8(), (PATCH, BANDS), dim_names=("frame", "band"))
    flat = np.frombuffer(b"".join(values), np.uint8)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat), PATCH * BANDS))


#: A tensor's storage: PATCH x BANDS bytes, frame by frame, log energies in steps of STEP from LOWEST.
STEP, LOWEST = 0.125, float(np.log(FLOOR))
_TENSOR = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("values", T.BinaryType())])


@F.pandas_udf(
    T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("patches", T.ArrayType(_TENSOR))])
)
def payload_and_feature(media: pd.Series) -> pd.DataFrame:
    """The samples read back from media, a one-line digest of all its patches and segments, and the patches as tensors of one shape.

    The digest has the length, the frames, the number and total length of
    segments and, for each band, the mean and the deviation over all frames.
    Null media gives nulls. ``patch_tensor`` makes Arrow tensors of the patches.
    """
    rows = []
    for m in media:
        if m is None:
            rows.append((None,) * 4)
            continue
        f = clip_features(m)
        mel = np.concatenate([np.zeros(0, np.float32), *(p["values"] for p in f["patches"])]).reshape(-1, BANDS)[: f["frames"]].astype(np.float64)
        bands = " ".join(f"{a:.3f}/{b:.3f}" for a, b in zip(mel.mean(0), mel.std(0), strict=True)) if len(mel) else ""
        up = sum(s["end"] - s["start"] for s in f["segments"])
        tensors = [p | {"values": np.clip(np.round((p["values"] - LOWEST) / STEP), 0, 255).astype(np.uint8).tobytes()} for p in f["patches"]]
        rows.append((bytes(from_wav(m)[1]), f"{f['seconds']:.4f}s {f['frames']}f {len(f['segments'])}x{up:.4f}s {bands}", [PATCH, BANDS], tensors))
    return pd.DataFrame(rows, columns=["payload", "feature", "shape", "patches"])
