"""What the training-data operators share: scratch tables, Arrow buffers, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import ship

#: Rows and bytes of one Arrow batch, whichever is reached first.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Bytes of text that numpy works on at a time.
SLICE = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir for this session. Where that is unset: a temporary one on a local master, an error on a cluster, whose executors couldn't share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "loomspark-checkpoints").as_uri()
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table goes with drop(), or else when the session's file system closes."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() has written, once nothing reads them any more."""
    for t in tables:
        where, fs = _at(t.sparkSession, t._loomspark_path)
        fs.delete(where, True)


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the session's Arrow batches; smaller bounds that are set stay."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(texts: DataFrame, text_col: str = "text", each: int = 16 << 20) -> int:
    """As many buckets as leave `each` bytes of text to one, and at least several for each shuffle partition, which evens them out."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4 * parts(texts.sparkSession), 64, -(-size // each))


def free(df: DataFrame, name: str) -> str:
    """name, with as many more underscores before it as leave it unlike all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that what is added beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def columns(df: DataFrame, of: str) -> list[Column]:
    """The columns of df, from the struct `of` that row() has made of them."""
    return [F.col(of)[c].alias(c) for c in df.columns]


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (as long; ids are integers) and the text (null: empty); whatever else the table has can't clash with what is added."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and where each value starts; no copy."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(array: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of values of about `most` bytes (one value at least): first, last, bytes, offsets from 0."""
    data, off = utf8(array)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


# ---- words and their hashes -------------------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1000003))


class Powers:
    """r^i and r^-i modulo 2^64, as far as they were needed so far."""

    def __init__(self, seed: int) -> None:
        self.r = int(seeds(1, seed)[0]) | 1
        self.inverse = pow(self.r, -1, 1 << 64)
        self.table = seeds(256, seed + 7)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, r in (("up", self.r), ("down", self.inverse)):
                x = np.full(max(n, 2 * len(self.up)), r, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = {seed: Powers(seed) for seed in (11, 12)}


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each document where its words begin."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~_WS[data]
    before = np.concatenate(([False], inside[:-1]))
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11, lower: bool = False) -> np.ndarray:
    """64 bits for each word, from its own bytes alone; a very long text is taken SLICE bytes at a time (one word at least)."""
    out = np.empty(len(starts), np.uint64)
    p, lo = _POWERS[seed], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        some, s, e = data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        up, down = p.to(len(some) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(p.table[_LOWER[some] if lower else some] * up[: len(some)], out=sums[1:])
            out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def gram_hashes(h: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """64 bits for each run of n words, from the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = _POWERS[seed]
    up, down = p.to(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


# ---- memory of Python workers -----------------------------------------------------------------

#: What workers keep from task to task, by operator. Workers outlive a stage, and count against the executor's memory while others work.
KEPT: dict[str, dict] = {}


def keep_only(operator: str) -> None:
    """Forget what other operators keep in this worker."""
    for name, tables in KEPT.items():
        if name != operator:
            tables.clear()


def give_back() -> None:
    """Return memory that is free, or quickly made anew, to the system."""
    for p in _POWERS.values():
        p.up = p.down = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: before it, what other operators keep in the worker goes, and after it, free memory."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return inside


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


# ---- connected components ---------------------------------------------------------------------


def local_links(adj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric link matrix hangs together with."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], big).min(axis=1))
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) between longs: node, component (the smallest node that can be reached).

    Large-star and small-star in turn until nothing changes; each round is a table in the shared folder, its
    minimum per node is combined before the shuffle, and no node's neighbours meet in one task."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, cut(small)
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(low, nodes.node == low.u, "left").select("node", F.coalesce("m", "node").alias("component"))


def token_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
