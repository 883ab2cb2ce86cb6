"""Inference of a small convolutional frame tagger in numpy: one posterior row for each mel frame.

Blocks of two 3x3 convolutions each halve the mel axis alone; what is left of it is collapsed into channels, residual dilated
convolutions follow over time, and a linear head gives class logits. Time keeps its length, so any utterance goes through.
Weights are those of a trained network with its normalisations folded into scale and shift of the convolution before them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.audio import N_MELS, alike, as_lists, floats, inner_rows, lengths

Layer = tuple[np.ndarray, np.ndarray]


def fold_norm(weight: np.ndarray, gain: np.ndarray, shift: np.ndarray, mean: np.ndarray, var: np.ndarray, eps: float = 1e-5) -> Layer:
    """Weight and bias of a convolution that does the normalisation after it as well."""
    scale = gain / np.sqrt(var + eps)
    return weight * scale.reshape(-1, *[1] * (weight.ndim - 1)), shift - mean * scale


def conv_time(x: np.ndarray, layer: Layer, dilation: int = 1) -> np.ndarray:
    """[..., channels, T] by weights [out, channels, taps] with an odd number of taps; zeros beyond the ends."""
    w, b = layer
    reach, n = w.shape[2] // 2 * dilation, x.shape[-1]
    padded = np.zeros((*x.shape[:-1], n + 2 * reach), x.dtype)
    padded[..., reach : reach + n] = x
    taps = np.concatenate([padded[..., k * dilation : k * dilation + n] for k in range(w.shape[2])], axis=-2)
    return w.transpose(0, 2, 1).reshape(len(w), -1) @ taps + b[:, None]


def conv_plane(x: np.ndarray, layer: Layer) -> np.ndarray:
    """[..., channels, mels, T] by weights [out, channels, 3, 3]; zeros beyond the edges.

    Planes lie flat with their edges, so each tap is one stretch of them; the two columns too many go at the end."""
    w, b = layer
    *lead, c, f, n = x.shape
    wide = n + 2
    flat = np.zeros((*lead, c, (f + 2) * wide + 2), x.dtype)
    flat[..., : (f + 2) * wide].reshape(*lead, c, f + 2, wide)[..., 1:-1, 1:-1] = x
    taps = np.concatenate([flat[..., k : k + f * wide] for k in (i * wide + j for i in range(3) for j in range(3))], axis=-2)
    out = w.transpose(0, 2, 3, 1).reshape(len(w), -1) @ taps + b[:, None]
    return out.reshape(*lead, len(w), f, wide)[..., :n]


def halve_mels(x: np.ndarray) -> np.ndarray:
    """Maximum of each two neighbours on the mel axis, the last but one; a last odd one stands alone."""
    if x.shape[-2] % 2:
        x = np.concatenate((x, x[..., -1:, :]), axis=-2)
    return np.maximum(x[..., ::2, :], x[..., 1::2, :])


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@dataclass(frozen=True)
class Tagger:
    """Weights, and what is needed to use them. `temporal` has (dilation, three-tap layer, one-tap layer)."""

    classes: tuple[str, ...]
    mean: float
    std: float
    planes: tuple[tuple[Layer, Layer], ...]
    collapse: Layer
    temporal: tuple[tuple[int, Layer, Layer], ...]
    head: Layer

    def logits(self, mel: np.ndarray) -> np.ndarray:
        """[..., T, classes] of a normalised mel [..., T, mels]; what stands beside an utterance has no part in its figures."""
        x = np.asarray(mel, np.float32).swapaxes(-1, -2)[..., None, :, :]
        for first, second in self.planes:
            x = halve_mels(relu(conv_plane(relu(conv_plane(x, first)), second)))
        w, b = self.collapse
        h = relu(w.reshape(len(w), -1) @ x.reshape(*x.shape[:-3], -1, x.shape[-1]) + b[:, None])
        for dilation, wide, point in self.temporal:
            h = relu(h + conv_time(relu(conv_time(h, wide, dilation)), point))
        return (self.head[0] @ h + self.head[1][:, None]).swapaxes(-1, -2)

    def normal(self, mel: np.ndarray) -> np.ndarray:
        return (np.asarray(mel, np.float32) - self.mean) / self.std

    def posteriors(self, mel: np.ndarray) -> np.ndarray:
        """[..., T, classes], each row a distribution, of raw mels of one length."""
        z = self.logits(self.normal(mel))
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    @property
    def receptive_field(self) -> int:
        """Frames that an output frame sees: a plane convolution adds one on each side, a dilated one its dilation."""
        return 1 + 4 * len(self.planes) + 2 * sum(d for d, _, _ in self.temporal)

    @property
    def n_params(self) -> int:
        layers = [x for block in self.planes for x in block] + [self.collapse, self.head] + [x for _, *block in self.temporal for x in block]
        return sum(w.size + b.size for w, b in layers)


def random_tagger(classes: list[str], channels: tuple[int, ...] = (4, 8), width: int = 16, dilations: tuple[int, ...] = (1, 2), seed: int = 0) -> Tagger:
    """An untrained tagger: the shapes without the knowledge, for tests and dry runs."""
    rng = np.random.default_rng(seed)
    layer = lambda *s: (rng.normal(0, (2 / np.prod(s[1:])) ** 0.5, s).astype(np.float32), np.zeros(s[0], np.float32))
    planes, before, mels = [], 1, N_MELS
    for c in channels:
        planes.append((layer(c, before, 3, 3), layer(c, c, 3, 3)))
        before, mels = c, -(-mels // 2)
    temporal = tuple((d, layer(width, width, 3), layer(width, width, 1)) for d in dilations)
    return Tagger(tuple(classes), 0.0, 1.0, tuple(planes), layer(width, before, mels), temporal, layer(len(classes), width))


def save(tagger: Tagger, path: str) -> None:
    """Weights and what is needed to use them as plain arrays (npz)."""
    arrays = {"classes": np.array(tagger.classes), "norm": np.array([tagger.mean, tagger.std]), "dilations": np.array([d for d, _, _ in tagger.temporal], np.int64)}
    layers = {f"plane{i}{j}": x for i, block in enumerate(tagger.planes) for j, x in enumerate(block)} | {f"time{i}{j}": x for i, (_, *block) in enumerate(tagger.temporal) for j, x in enumerate(block)} | {"collapse": tagger.collapse, "head": tagger.head}
    np.savez(path, **arrays, **{f"{k}_{part}": x for k, layer in layers.items() for part, x in zip("wb", layer, strict=True)})


def load(path: str) -> Tagger:
    """A tagger that save() has written; nothing but arrays is read."""
    with np.load(path, allow_pickle=False) as z:
        layer = lambda k: (z[f"{k}_w"], z[f"{k}_b"])
        n = sum(1 for k in z.files if k.startswith("plane") and k.endswith("0_w"))
        temporal = tuple((int(d), layer(f"time{i}0"), layer(f"time{i}1")) for i, d in enumerate(z["dilations"]))
        return Tagger(tuple(map(str, z["classes"])), float(z["norm"][0]), float(z["norm"][1]), tuple((layer(f"plane{i}0"), layer(f"plane{i}1")) for i in range(n)), layer("collapse"), temporal, layer("head"))


def tiled_posteriors(tagger: Tagger, mel: np.ndarray, size: int) -> np.ndarray:
    """What one pass over mel gives, from stretches of `size` frames with the receptive field as a margin: memory follows the stretch, not the utterance."""
    margin = tagger.receptive_field // 2
    out = []
    for k in range(0, len(mel), size):
        lo = max(0, k - margin)
        out.append(tagger.posteriors(mel[lo : k + size + margin])[k - lo : k - lo + size])
    return np.concatenate(out) if out else np.zeros((0, len(tagger.classes)), np.float32)


def posteriors_udf(spark: SparkSession, tagger: Tagger, mel: Column) -> Column:
    """array<array<float>> of a column of mels; those of one length go through the network together. The weights, of fixed size, are broadcast."""
    sent = spark.sparkContext.broadcast(tagger)

    def run(mels: pa.Array) -> pa.Array:
        t, n, x = sent.value, lengths(mels), inner_rows(mels)
        start, out = np.cumsum(n) - n, np.empty((len(x), len(t.classes)), np.float32)
        for same in alike(n, 1 << 9):
            at = start[same][:, None] + np.arange(n[same[0]])
            out[at] = t.posteriors(x[at])
        return as_lists(as_lists(floats(out), np.full(len(out), len(t.classes))), n, n == 0)

    return F.arrow_udf(run, T.ArrayType(T.ArrayType(T.FloatType())))(mel)


def known_or_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0, x)


def best_runs(p: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """utterance, class, start, n, confidence of the runs of utterances that stand one after the other in p [frames, classes], n frames each.

    The sums are those of decode.smooth, term by term. NaN is what null is there: sums and means leave it out, and any figure is better."""
    p, utt = p.astype(np.float64), np.repeat(np.arange(len(n)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    last, i = first + np.repeat(n, n) - 1, np.arange(len(p))
    if width > 1:
        back, ahead = width // 2, width - 1 - width // 2
        total, known = np.zeros_like(p), np.zeros(p.shape, bool)
        for k in range(-back, ahead + 1):
            inside = (i + k >= first) & (i + k <= last)
            total[inside] += known_or_zero(p[i[inside] + k])
            known[inside] |= ~np.isnan(p[i[inside] + k])
        total[~known] = np.nan
        left, right = np.maximum(back - (i - first), 0), np.maximum(i + ahead - last, 0)
        p = (total + left[:, None] * p[first] + right[:, None] * p[last]) / width
    best = np.where(np.isnan(p), -np.inf, p).argmax(axis=1)
    new = (i == first) | (best != np.roll(best, 1))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(p)))
    top = p[i, best]
    sums, known = (np.add.reduceat(x, start) if len(p) else np.zeros(0) for x in (known_or_zero(top), (~np.isnan(top)).astype(np.float64)))
    return utt[start], best[start], start - first[start], size, np.divide(sums, known, out=np.full(len(start), np.nan), where=known > 0)


def runs_udf(posteriors: Column, width: int = 1) -> Column:
    """array<struct<class, start, n, confidence>> by start, of a column of whole utterances: what decode.runs(decode.argmax(decode.smooth())) finds without
    gates, with no row for each frame and class; a run of unknown figures has confidence null. Null where there are no frames."""

    def run(rows: pa.Array) -> pa.Array:
        n = lengths(rows)
        utt, best, start, size, confidence = best_runs(inner_rows(rows), n, width)
        got = pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int64()), floats(confidence)], ["class", "start", "n", "confidence"])
        return as_lists(got, np.bincount(utt, minlength=len(n)), n == 0)

    return F.arrow_udf(run, "array<struct<class:int,start:int,n:bigint,confidence:double>>")(posteriors)


def long_posteriors(rows: DataFrame, posteriors: str, utt: str = "utt") -> DataFrame:
    """(utt, t, class, p): one row for each frame and class."""
    frames = rows.select(utt, F.posexplode(posteriors).alias("t", "row"))
    return frames.select(utt, "t", F.posexplode("row").alias("class", "p")).withColumn("p", F.col("p").cast("double"))


def masked_hits_udf(spark: SparkSession, tagger: Tagger, mel: Column, spans: Column, margins: list[int]) -> Column:
    """Of spans array<struct<class, start, end>>: array<struct<class, margin, hit>>, whether the middle frame is classed rightly.

    Margin null sees the whole utterance; any other sees so many frames on either side of the span, and zeros beyond. Spans
    of fewer than two frames inside the utterance are left out."""
    sent = spark.sparkContext.broadcast(tagger)
    reach: list[int | None] = [None, *margins]

    def run(mels: pd.Series, all_spans: pd.Series) -> pd.Series:
        t = sent.value
        out: list[list[dict]] = []
        for m, own in zip(mels, all_spans, strict=True):
            got: list[dict] = []
            if m is not None and len(m) and own is not None:
                x = t.normal(np.stack(m))
                whole = t.logits(x).argmax(axis=1)
                for s in own:
                    a, b = max(0, int(s["start"])), min(len(x), int(s["end"]))
                    if b - a < 2:
                        continue
                    middle = (a + b) // 2
                    for r in reach:
                        if r is None:
                            best = whole[middle]
                        else:
                            seen = np.zeros_like(x)
                            lo, hi = max(0, a - r), min(len(x), b + r)
                            seen[lo:hi] = x[lo:hi]
                            best = t.logits(seen)[middle].argmax()
                        got.append({"class": int(s["class"]), "margin": r, "hit": bool(best == s["class"])})
            out.append(got)
        return pd.Series(out)

    return F.pandas_udf(run, "array<struct<class:int,margin:int,hit:boolean>>")(mel, spans)
