"""PCM decoding and log-mel features as Arrow functions: array kernels that SQL has no counterpart for."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sampling and filter bank.
RATE, N_FFT, HOP, N_MELS, F_MIN, F_MAX = 16_000, 400, 160, 40, 20.0, 7600.0


def n_frames(n_samples):
    return n_samples // HOP + 1


@cache
def mel_filters() -> np.ndarray:
    """Triangles on the HTK mel scale, without area normalisation: [N_FFT // 2 + 1, N_MELS]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(F_MIN), mel(F_MAX), N_MELS + 2) / 2595) - 1)
    f = np.linspace(0, RATE / 2, N_FFT // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray) -> np.ndarray:
    """[..., frames, N_MELS] of samples [..., n]: centred frames, periodic Hann window, power spectrum, log10 floored at 1e-10."""
    pad = N_FFT // 2
    x = np.asarray(x, np.float64)
    x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(pad, pad)], mode="reflect" if x.shape[-1] > pad else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT, -1)[..., ::HOP, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    return np.log10(np.maximum((np.abs(np.fft.rfft(frames * window)) ** 2) @ mel_filters(), 1e-10)).astype(np.float32)


def lengths(lists: pa.Array) -> np.ndarray:
    """Of each list; 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def inner_rows(lists: pa.Array) -> np.ndarray:
    """The inner lists of lists of lists of numbers, all of one length, as the rows of one array; null is NaN."""
    rows = lists.flatten()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)


def floats(x: np.ndarray) -> pa.Array:
    """All numbers of x, row by row; NaN is null."""
    return pa.array(x.ravel(), from_pandas=True)


def as_lists(values: pa.Array, sizes: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Lists of so many values each, one after the other; null where none says so."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=None if none is None else pa.array(none))


def alike(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of equal size, together as many as stay within `most` (one at least): what array kernels take at once. None of size 0."""
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        step = max(1, most // int(sizes[same[0]]))
        yield from (same[k : k + step] for k in range(0, len(same), step))


def _log_mels(waves: pa.Array) -> pa.Array:
    n, x = lengths(waves), waves.flatten().to_numpy(zero_copy_only=False)
    start, frames = np.cumsum(n) - n, np.where(n > 0, n_frames(n), 0)
    out, to = np.empty((int(frames.sum()), N_MELS), np.float32), np.cumsum(frames) - frames
    for same in alike(n, 1 << 17):
        out[to[same][:, None] + np.arange(frames[same[0]])] = log_mel(x[start[same][:, None] + np.arange(n[same[0]])])
    return as_lists(as_lists(floats(out), np.full(len(out), N_MELS)), frames, n == 0)


def log_mel_udf(wave_col: Column) -> Column:
    """array<array<float>> of a column of samples."""
    return F.arrow_udf(_log_mels, T.ArrayType(T.ArrayType(T.FloatType())))(wave_col)


def _tones(pitch: pa.Array, n: pa.Array) -> pa.Array:
    sizes, by = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), pitch.to_numpy(zero_copy_only=False)
    out, to = np.empty(int(sizes.sum()), np.float32), np.cumsum(sizes) - sizes
    for same in alike(sizes, 1 << 17):
        at = np.arange(sizes[same[0]])
        with np.errstate(invalid="ignore", over="ignore"):
            out[to[same][:, None] + at] = np.sin(at * by[same][:, None] / 500)
    return as_lists(pa.array(out), sizes)


def tone_udf(pitch: Column, n: Column) -> Column:
    """array<float>: n samples of a sine that moves on by pitch / 500 with each."""
    return F.arrow_udf(_tones, T.ArrayType(T.FloatType()))(pitch.cast("double"), n.cast("int"))


def _integers(raw: bytes, width: int) -> np.ndarray:
    """Samples of 8 (unsigned), 16, 24 or 32 bits in -1..1."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return (x - ((x & 0x800000) << 1)) / 8388608
    return np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / (1 << 8 * width - 1)


def _decoded(raw: pd.Series) -> pd.DataFrame:
    """WAV bytes to mono samples at RATE; what can't be read gives an error, never a failure."""
    out = []
    for b in raw:
        try:
            with wave.open(io.BytesIO(b)) as w:
                x = _integers(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels()).mean(axis=1)
                if w.getframerate() != RATE:
                    n = round(len(x) * RATE / w.getframerate())
                    x = np.interp(np.arange(n) * w.getframerate() / RATE, np.arange(len(x)), x)
            out.append((x.astype(np.float32).tolist(), None))
        except Exception as e:  # noqa: BLE001
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["samples", "error"])


def decode_pcm(raw_col: Column) -> Column:
    """struct<samples, error> of a column of WAV bytes."""
    return F.pandas_udf(_decoded, "struct<samples:array<float>, error:string>")(raw_col)


def scaled(samples: Column, peak: float = 1.5) -> Column:
    """Samples in -1..1: those of 16-bit integers, whose peak is beyond `peak`, are divided by 32768."""
    most = F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    return F.transform(samples, lambda x: F.when(most > peak, x.cast("double") / 32768.0).otherwise(x.cast("double")))


def waveform(field: Column, names: list[str]) -> Column:
    """struct<samples, error> of a struct that holds an array of samples, WAV bytes, or both; the array comes first."""
    decoded = decode_pcm(field["bytes"]) if "bytes" in names else F.struct(F.lit(None).cast("array<float>").alias("samples"), F.lit("no samples and no bytes").alias("error"))
    if "array" not in names:
        return decoded
    own = scaled(field["array"]).cast("array<float>")
    return F.when(field["array"].isNotNull(), F.struct(own.alias("samples"), F.lit(None).cast("string").alias("error"))).otherwise(decoded)
