"""Best-fit packing of token sequences by large-item matching.

Documents are tokenized, closed by an end id and cut only where they are longer than a sequence. The packing is
planned on the histogram of piece lengths, which has `capacity` entries however large the corpus is: pieces above a third of the
capacity are matched greedily, the largest with the largest partner that still fits, so that a sequence holds two of
them at most; smaller pieces then go, longest first, to the tightest gap that takes them, and open new sequences only
where none does. The plan says which ranks of a length go to which sequences; each piece finds its place by its rank.

Each row of the table has a number of its own beside its id, so that copies can be told apart. With a seed, sequences are numbered in a
random order: the plan's own has the longest pieces first.

Defined results: null and empty texts are one piece that holds the end id alone; ties and repeated rows are placed by
their rank in any order; a null id stays null; an empty table gives no rows; a very long text is tokenized whole; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._common import KEPT, binaries, cut, ids_and_texts, lean, prepare, token_path

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Words that a worker remembers in each of two generations; what falls out is tokenized anew.
REMEMBERED = 500_000
#: Rows of a length that are ranked together.
RANKED = 1 << 20


_BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_BYTE_LEVEL = {b: b for b in _BYTES} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _BYTES)}
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class WordIds(dict):
    """Ids (little-endian 32-bit) of words: the tokenizer never merges across ASCII white space, and words recur.

    Printable Latin words are lower-cased and split here as the vocabulary file says, and go straight to its BPE model;
    all others go through the whole tokenizer."""

    made: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            w = word.decode()
            if _PLAIN.fullmatch(w) and "<|" not in w:
                bpe = self.model.tokenize
                found = [t.id for p in _PIECES.findall(w.lower()) for t in bpe(p.encode().decode("latin-1").translate(_BYTE_LEVEL))]
            else:
                found = self.tokenizer.encode(w, add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text."""
        out = b"".join(map(self.__getitem__, text.split()))
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        return out


KEPT["packing"] = WordIds.made


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, row (a number for each row of docs), piece, start, length, ids_crc32, and with with_ids also ids (binary, little-endian 32-bit)."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds.of(path)
        for b in batches:
            ids, texts = list(zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), strict=True)), b["text"].to_pylist()
            for at in range(0, len(ids), 100):
                rows: list[tuple] = []
                for doc, code in zip(ids[at : at + 100], map(coder.encode, texts[at : at + 100]), strict=True):
                    code += end
                    for k in range(0, len(code), 4 * capacity):
                        part = code[k : k + 4 * capacity]
                        rows.append((*doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
                cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:6], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    cols.append(binaries([r[6] for r in rows]))
                yield pa.RecordBatch.from_arrays(cols, [*"doc_id row piece start length ids_crc32".split(), *["ids"] * with_ids])

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ids_and_texts(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(lean("packing", run), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the ranks of each length go, and the number of sequences.

    Rows: length, first rank, first sequence, pieces in each sequence, offset of the first of them. Sequences are
    handled in ranges that are filled alike, so there are some thousand rows whatever the counts are."""
    left = {n: c for n, c in histogram.items() if c}
    rows: list[tuple[int, int, int, int, int]] = []
    placed: dict[int, int] = dict.fromkeys(left, 0)
    bins = 0
    gaps: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first sequence, number)

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, n))

    def put(length: int, first: int, n: int, each: int, offset: int) -> None:
        rows.append((length, placed[length], first, each, offset))
        placed[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        k -= k >= 0 and large[k] == a and left[a] == 1
        if k < 0:
            n, b = left[a], 0
        elif (b := large[k]) == a:
            n = left[a] // 2
        else:
            n = min(left[a], left[b])
        if b and n:
            put(a, bins, n, 1, 0)
            put(b, bins, n, 1, a)
        else:
            b, n = 0, 1 if k >= 0 else n
            put(a, bins, n, 1, 0)
        leave(capacity - a - b, bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                gap, ranges = capacity, [(bins, -(-left[length] // (capacity // length)))]
                bins += ranges[0][1]
            else:
                gap = gaps.pop(k)
                ranges = open_.pop(gap)
            each = gap // length
            for at, (first, n) in enumerate(ranges):
                full = min(n, left[length] // each)
                if full:
                    put(length, first, full * each, each, capacity - gap)
                    leave(gap - each * length, first, full)
                if full < n:
                    some = left[length]  # fewer than a sequence takes
                    if some:
                        put(length, first + full, some, some, capacity - gap)
                        leave(gap - some * length, first + full, 1)
                    leave(gap, first + full + bool(some), n - full - bool(some))
                    for rest in ranges[at + 1 :]:
                        leave(gap, *rest)
                    break
    return np.array(rows, np.int64).reshape(-1, 5), bins


def dealt(n: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A permutation of 0..size-1 at n: rounds that mix as many bits as size has, again for what falls beyond it."""
    bits = max(2, (size - 1).bit_length())
    mask, half = (1 << bits) - 1, bits // 2
    odd = [int(x) | 1 for x in np.random.default_rng(seed).integers(1, 1 << 62, 4)]
    out, left = n.astype(np.int64).copy(), np.arange(len(n))
    while len(left):
        x = out[left].astype(np.uint64)
        for m in odd:
            x = (x * np.uint64(m) + np.uint64(m >> 7)) & np.uint64(mask)
            x ^= x >> np.uint64(half)
        out[left] = x.astype(np.int64)
        left = left[out[left] >= size]
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, seed: int | None = None) -> DataFrame:
    """pieces (a stored table) with sequence_id and offset.

    Only the histogram of lengths, of `capacity` rows at most, and the plan made of it are on the driver."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, bins = plan(counts, capacity)
    if len(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    salts = -(-max([0, *counts.values()]) // RANKED) * 16 + 16
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy(F.xxhash64("row"), "row", "piece")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("base")).drop("salt", "r", "base")
    shift = 1 << 44
    keys = rows[:, 0] * shift + rows[:, 1]
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            row = rows[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(rows) else np.zeros((0, 5), np.int64)
            nth = rank - row[:, 1]
            seq, off = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            if seed is not None:
                seq = dealt(seq, bins, seed)
            yield pa.RecordBatch.from_arrays([b[c] for c in names[:-2]] + [pa.array(seq), pa.array(off)], names)

    prepare(spark)
    return ranked.mapInArrow(lean("packing", run), schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, seed: int | None = None) -> DataFrame:
    """Pieces of docs with their places: doc_id, row, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return place(cut(tokenized(docs, path or token_path(VOCABULARY), capacity, end_id, with_ids)), capacity, seed)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
