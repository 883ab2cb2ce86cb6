"""Toxicity scores from subword-bag embeddings under a linear softmax, trained jointly in numpy.

A bag holds the hashed character n-grams (3 to 5 bytes, with word ends) of WIDE consecutive words (a run of one word
counts once); its mean embedding
goes through a linear softmax. Labels are of documents, so training alternates: first on the windows whose n-grams
toxic documents hold more often, then on those that the model itself finds most toxic, in toxic and in clean documents.
A document's score is a logistic of its most toxic window and its number of windows, fitted on sampled documents that
the embeddings did not see. As the softmax is linear, each n-gram has one number, and whole texts are scored with sums.

The fit alone is bounded: FIT_TOXIC and FIT_CLEAN labelled documents by the order of their hashes, and of each a stretch of FIT_CHARS
characters from a hashed place on (most are shorter, and whole).

Defined results: null texts, empty texts and texts without words score 0; without labels of both kinds every text scores 0; repeated rows
and rows that repeat an id are scored each by its text; very long texts are scored whole; a null id is scored and in no fold; of an id with
several texts the least teaches, and one with labels of both kinds doesn't; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import ids_and_texts, prepare, slices, word_hashes, words

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 1500, 2500, 40_000
WIDE, BITS, DIM = 8, 17, 8
#: Windows drawn at random from a clean document; most toxic windows taken of a toxic and of a clean document.
DRAWN, OF_TOXIC, OF_CLEAN = 4, 2, 3
ROUNDS, BATCH, RATE = 3, 256, 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each byte, which of them count, and words (starts, ends, first of each text), all in texts set apart by spaces. A word that repeats the one before it is left out."""
    n = len(off) - 1
    b = np.full(len(data) + n + 5, 32, np.uint32)
    b[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(off))] = _FOLD[data]
    apart = np.append(off[:-1] + np.arange(n) + 1, len(data) + n + 1)
    raw = b.astype(np.uint8)
    starts, ends, ptr = words(raw, apart)
    same = word_hashes(raw, starts, ends)
    fresh = np.concatenate(([True], same[1:] != same[:-1])) if len(same) else np.zeros(0, bool)
    fresh[ptr[:-1][ptr[:-1] < len(fresh)]] = True
    starts, ends, ptr = starts[fresh], ends[fresh], np.concatenate(([0], np.cumsum(fresh)))[ptr]
    size = len(b) - 5
    h, buckets, valid = b, [], []
    word = b != 32
    ok = np.ones(size, bool)
    for k in range(1, 5):
        h = h[:-1] * np.uint32(0x01000193) ^ b[k:]
        if k >= 2:
            ok = ok & word[k - 1 : k - 1 + size]
            buckets.append(((h[:size] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
            valid.append(ok)
    return buckets, valid, starts, ends, ptr


def window_logits(data: np.ndarray, off: np.ndarray, weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows of WIDE words, the first word of each, and where each text's windows begin."""
    buckets, valid, starts, ends, ptr = grams(data, off)
    value, count = np.zeros(len(valid[0]) + 2), np.zeros(len(valid[0]) + 2, np.int64)
    for b, v in zip(buckets, valid, strict=True):
        value[2:] += np.where(v, weight[b], 0)
        count[2:] += v
    # an n-gram belongs to the word of its second byte
    value, count = np.cumsum(value), np.cumsum(count)
    value = np.concatenate(([0], np.cumsum(value[ends] - value[starts])))
    count = np.concatenate(([0], np.cumsum(count[ends] - count[starts])))
    n = np.diff(ptr)
    each = np.where(n > 0, np.maximum(n - WIDE + 1, 1), 0)
    at = np.concatenate(([0], np.cumsum(each)))
    first = np.repeat(ptr[:-1], each) + np.arange(at[-1]) - np.repeat(at[:-1], each)
    last = np.minimum(first + WIDE, np.repeat(ptr[1:], each)) - 1
    if not len(first):
        return np.zeros(0), first, at
    return (value[last + 1] - value[first]) / np.maximum(count[last + 1] - count[first], 1) + bias, first, at


class Model:
    def __init__(self, weight: np.ndarray, bias: float, head: np.ndarray) -> None:
        self.weight, self.bias, self.head = weight, bias, head

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        logits, _, at = window_logits(data, off, self.weight, self.bias)
        n = np.diff(at)
        top = np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            top[some] = np.maximum.reduceat(logits, at[:-1][some])
        return np.column_stack((np.ones(len(n)), top, np.log1p(n)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = self.features(data, off)
        return np.where(x[:, 2] > 0, 1 / (1 + np.exp(-np.clip(x @ self.head, -50, 50))), 0.0)


def _bags(texts: list[bytes], pick: list[np.ndarray]) -> list[np.ndarray]:
    """Buckets of the windows that begin at the picked words of each text."""
    out = []
    for lo in range(0, len(texts), 64):
        some = texts[lo : lo + 64]
        data = np.frombuffer(b"".join(some), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in some])))
        buckets, valid, starts, ends, ptr = grams(data, off)
        for d in range(len(some)):
            for w in pick[lo + d]:
                own = range(min(ptr[d] + w, ptr[d + 1] - 1), min(ptr[d] + w + WIDE, ptr[d + 1]))
                out.append(np.concatenate([b[starts[k] - 1 : ends[k] - 1][v[starts[k] - 1 : ends[k] - 1]] for k in own for b, v in zip(buckets, valid, strict=True)]))
    return out


def _softmax_fit(bags: list[np.ndarray], y: np.ndarray, emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Stochastic gradient steps on embeddings, softmax and bias together, each kind weighted alike."""
    keep = [k for k in range(len(bags)) if len(bags[k])]
    share = np.array([max(1, np.sum(y[keep] == c)) for c in (0, 1)])
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(keep)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            size = np.array([len(bags[k]) for k in some])
            idx = np.concatenate([bags[k] for k in some])
            mean = np.add.reduceat(emb[idx], np.cumsum(size) - size) / size[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= (len(keep) / 2 / share)[y[some]][:, None] / 16
            back = p @ soft.T / size[:, None]
            soft -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0)
            np.add.at(emb, idx, (-rate * 20) * np.repeat(back, size, axis=0))


def _picked(texts: list[bytes], y: np.ndarray, weight: np.ndarray, bias: float, rng: np.random.Generator) -> list[np.ndarray]:
    """First words of each text's most toxic windows, which don't overlap much, and of some others in clean texts."""
    pick = []
    for lo in range(0, len(texts), 64):
        some = texts[lo : lo + 64]
        off = np.concatenate(([0], np.cumsum([len(t) for t in some])))
        logits, _, at = window_logits(np.frombuffer(b"".join(some), np.uint8), off, weight, bias)
        for d in range(len(some)):
            z = logits[at[d] : at[d + 1]]
            top: list[int] = []
            for w in np.argsort(-z)[: 12 * WIDE].tolist():
                if len(top) < (OF_TOXIC if y[lo + d] else OF_CLEAN) and all(abs(w - t) >= WIDE // 2 for t in top):
                    top.append(w)
            extra = rng.choice(len(z), min(len(z), DRAWN), replace=False).tolist() if len(z) and not y[lo + d] else []
            pick.append(np.array(top + extra, np.int64))
    return pick


def train(texts: list[bytes], y: np.ndarray, seed: int = 5) -> Model | None:
    """Embeddings, softmax and head from labelled texts (UTF-8); None if they are all of one kind."""
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, rest = order[len(order) // 4 :], order[: len(order) // 4]
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    soft, bias = rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    own = [texts[k] for k in fit]
    # document frequencies name the first windows; embeddings and softmax take over from there
    seen = np.zeros((2, 1 << BITS))
    for k, t in zip(fit, own, strict=True):
        buckets, valid, *_ = grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        seen[y[k], np.unique(np.concatenate([b[v] for b, v in zip(buckets, valid, strict=True)]))] += 1
    share = (seen + 0.5) / (np.bincount(y[fit], minlength=2)[:, None] + 1)
    pick = _picked(own, y[fit], np.log(share[1] / share[0]).astype(np.float32), 0.0, rng)
    for turn in range(ROUNDS):
        _softmax_fit(_bags(own, pick), np.repeat(y[fit], [len(p) for p in pick]), emb, soft, bias, 2 if turn else 3, rng)
        weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        pick = _picked(own, y[fit], weight, float(bias[1] - bias[0]), rng)
    model = Model(weight, float(bias[1] - bias[0]), np.zeros(3))
    x = np.concatenate([model.features(np.frombuffer(texts[k], np.uint8), np.array([0, len(texts[k])])) for k in rest])
    head = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + 0.01 * np.eye(3), x.T @ (y[rest] - p) - 0.01 * head)
        head = head + np.clip(step, -2, 2)
    model.head = head
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on a bounded sample of labelled documents outside the held-out fold."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = told.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic", F.xxhash64("doc_id").alias("k"))
    some = lambda y, n: known.where(F.col("toxic") == y).orderBy("k", "doc_id").limit(n)
    drawn = some(1, FIT_TOXIC).unionByName(some(0, FIT_CLEAN))
    place = F.pmod("k", F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1).cast("int") + 1
    mine = ids_and_texts(docs).join(F.broadcast(drawn), "doc_id").select("k", "toxic", F.substring("text", place, F.lit(FIT_CHARS)).alias("text"))
    rows = mine.groupBy("k", "toxic").agg(F.min("text").alias("text")).select("k", "toxic", F.encode("text", "UTF-8").alias("text")).collect()
    rows.sort(key=lambda r: (r.k, bytes(r.text)))
    return train([bytes(r.text) for r in rows], np.array([r.toxic for r in rows], np.int64))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of docs. The model, of fixed size, is broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = np.zeros(b.num_rows)
            if m:
                for lo, hi, data, off in slices(b["text"]):
                    out[lo:hi] = m.score(data, off)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out)], ["doc_id", "score"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
