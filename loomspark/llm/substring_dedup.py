"""Substring deduplication over a log-structured fingerprint index.

A window is WINDOW consecutive words. Each window points to one of its GRAM-word fingerprints, the least (leftmost of equals);
equal windows point to the same one, so only those anchors, one in some fourteen words, enter the index. The index is a log of
immutable runs, sorted by fingerprint within buckets, and a manifest that names them; it outlives the session where a
path is given. A new batch, sorted, is merge-joined with the runs of its bucket, tells which anchors now occur twice (its own
and historical ones), and becomes a run itself; when there are FANOUT runs they are merged to one before the next batch. Windows of
repeated anchors are then verified by a 64-bit hash of their whole word sequence, from other word hashes than the anchor's own
64 bits, and the words that repeated ones cover are cut.

Copies of an anchor, or of a whole stretch of windows, that one task sees are combined before the shuffle: a bucket
gets one entry of each for a task, however many documents share it. Windows across the edge of a passage that very many
documents share differ, and yet have one anchor: a bucket of more than HOT times the mean is dealt again, by its windows' hashes.

Documents are told apart by 128 bits of id and text where words are cut; where anchors are looked up, by 64 bits, and there a
collision only has more windows verified.

Defined results: null and empty texts have no words; texts of fewer words than a window lose none; repeated rows are documents of their own (each
loses what the other holds); very long texts are taken whole; an empty table gives no rows; rows with a null id or with an id that repeats
are documents as others are; other columns don't matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import buckets_for, cut, gram_hashes, ids_and_texts, mix, parts, prepare, scratch_dir, slices, utf8, word_hashes, words

WINDOW, GRAM = 35, 8
#: Runs that are compacted to one; entries that a task gathers before it sends them.
FANOUT, FLUSH = 2, 400_000
#: Times the mean size of a bucket beyond which its windows are dealt again.
HOT = 4
#: The place of what stands for several.
_NONE = -1
_DOC = np.dtype([("a", "<i8"), ("b", "<i8")])


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's word hashes: fingerprints of its grams, and for each window which gram is its anchor."""
    g = gram_hashes(h, gram)
    wide = window - gram + 1
    n = len(g) - wide + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    at = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        view = np.lib.stride_tricks.sliding_window_view(g[lo : hi + wide - 1], wide)
        at[lo:hi] = view.argmin(axis=1) + np.arange(lo, hi)
    return g, at


def _parts_of(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _frame(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


_ENTRY = "bucket int, kind int, key binary, uid binary, pos binary"
_NAMES, _TYPES = ["bucket", "kind", "key", "uid", "pos"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
RUN, HIT = 0, 1


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts key, where each run of equals begins, and how long it is."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def entries(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Anchors of docs (uid, text) in packed rows by bucket; those that a task sees twice are hits at once, and stand once with no place."""

    def flush(key: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        order, first, n = repeats(key)
        many = np.repeat(n > 1, n)
        rows = [(0, HIT, b"", uid[order[many]].tobytes(), pos[order[many]].tobytes())]
        k, u, p = key[order[first]], uid[order[first]], np.where(n > 1, _NONE, pos[order[first]]).astype(np.int32)
        for b, at in _parts_of((k % np.uint64(buckets)).astype(np.int64)):
            rows.append((b, RUN, k[at].tobytes(), u[at].tobytes(), p[at].tobytes()))
        return _frame(rows, _NAMES, _TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0
        for b in batches:
            uids = b["uid"].to_numpy()
            for lo, _, data, off in slices(b["text"]):
                starts, ends, ptr = words(data, off)
                h = word_hashes(data, starts, ends)
                for d in np.flatnonzero(np.diff(ptr) >= window).tolist():
                    g, at = anchors(h[ptr[d] : ptr[d + 1]], window, gram)
                    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                    held.append((g[at], np.full(len(at), uids[lo + d]), at.astype(np.int32)))
                    total += len(at)
                if total > FLUSH:
                    yield flush(*map(np.concatenate, zip(*held, strict=True)))
                    held, total = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held, strict=True)))

    return docs.mapInArrow(run, _ENTRY)


def _unpack(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda c, t: np.frombuffer(b"".join(df[c]), t)
    return join("key", np.uint64), join("uid", np.int64), join("pos", np.int32)


def _found(run: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two sorted lists of different keys: which of `keys` are in `run`, and where those stand there."""
    at = np.searchsorted(run, keys)
    inside = at < len(run)
    inside[inside] = run[at[inside]] == keys[inside]
    return inside, at[inside]


def _merged(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Merge-join of one bucket's sorted pieces with its sorted runs: hits on both sides, and the sorted run of what is new."""
    key, uid, pos = _unpack(new)
    order, first, n = repeats(key)  # a stable sort of sorted pieces merges them
    one = order[first]
    k = key[one]
    again = (n > 1) | (np.minimum.reduceat(pos[order], first) < 0) if len(first) else np.zeros(0, bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for row in range(len(old)):
        hk, hu, hp = _unpack(old.iloc[row : row + 1])
        seen, at = _found(hk, k)
        again = again | seen
        at = at[hp[at] >= 0]
        hits.append((hu[at], hp[at]))
    out = order[np.repeat(again, n)]
    out = out[pos[out] >= 0]
    hits.append((uid[out], pos[out]))
    u, p = (np.concatenate(x) for x in zip(*hits, strict=True))
    bucket = int(new["bucket"].iloc[0])
    rp = np.where(again, _NONE, pos[one]).astype(np.int32)
    return pd.DataFrame([(bucket, RUN, k.tobytes(), uid[one].tobytes(), rp.tobytes()), (bucket, HIT, b"", u.tobytes(), p.tobytes())], columns=_NAMES)


def _compacted(rows: pd.DataFrame) -> pd.DataFrame:
    """Sorted runs of one bucket merged to one: a key that several hold has been reported, and stands without a place."""
    key, uid, pos = _unpack(rows.iloc[:1])
    for row in range(1, len(rows)):
        k, u, p = _unpack(rows.iloc[row : row + 1])
        twice, at = _found(key, k)
        pos = pos.copy()
        pos[at] = _NONE
        k, u, p = k[~twice], u[~twice], p[~twice]
        at = np.searchsorted(key, k)
        key, uid, pos = np.insert(key, at, k), np.insert(uid, at, u), np.insert(pos, at, p)
    return pd.DataFrame([(int(rows["bucket"].iloc[0]), RUN, key.tobytes(), uid.tobytes(), pos.astype(np.int32).tobytes())], columns=_NAMES)


class FingerprintLog:
    """The index: runs of historical anchors in a folder, merged with each batch that is appended.

    With a path, the folder holds what earlier sessions have appended, and its own window, gram and number of buckets; without one it goes
    with the session. A run counts once a manifest names it; manifests are numbered, and the last one holds."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
        prepare(spark)
        jvm = spark.sparkContext._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(self.path, name) if name else jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not path:
            self._fs.deleteOnExit(self._path())
        self.state = {"version": 0, "window": window, "gram": gram, "buckets": buckets or max(4 * parts(spark), 64), "runs": [], "old": []}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path())) if self._fs.exists(self._path()) else []
        names = [n for n in names if n.startswith("manifest-")]
        if names:
            stream = self._fs.open(self._path(names[-1]))
            try:
                known = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            if (known["window"], known["gram"]) != (window, gram) or buckets not in (None, known["buckets"]):
                raise ValueError(f"the index at {self.path} has windows of {known['window']} words, anchors of {known['gram']}, {known['buckets']} buckets")
            self.state = known
        self.window, self.gram, self.buckets = window, gram, self.state["buckets"]

    def _commit(self, runs: list[str], old: list[str]) -> None:
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs, "old": old}
        name = f"manifest-{self.state['version']:08d}"
        stream = self._fs.create(self._path(f"_{name}"), True)
        stream.write(bytearray(json.dumps(self.state).encode()))
        stream.close()
        self._fs.rename(self._path(f"_{name}"), self._path(name))

    def _written(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{name}")

    def runs(self) -> DataFrame:
        out = self.spark.createDataFrame([], _ENTRY)
        for name in self.state["runs"]:
            out = out.unionByName(self._run(name).where(F.col("kind") == RUN))
        return out

    def append(self, texts: DataFrame) -> DataFrame:
        """Index texts (uid, text); returns hits (uid, pos): anchors, of this batch and of earlier ones, that are known to repeat from now on."""
        if len(self.state["runs"]) >= self.fanout:
            self.compact()
        # dealt by bucket once, where the runs are merged
        new = cut(entries(texts, self.buckets, self.window, self.gram))
        fresh = new.where(F.col("kind") == RUN)
        name = self._written(fresh.groupBy("bucket").cogroup(self.runs().groupBy("bucket")).applyInPandas(lambda a, b: _merged(a, b) if len(a) else b[:0], _ENTRY))
        self._commit([*self.state["runs"], name], self.state["old"])
        return self._places(new.where(F.col("kind") == HIT).unionByName(self._run(name).where(F.col("kind") == HIT)))

    def compact(self) -> None:
        """All runs become one. Those it replaces stay until vacuum(), as hits that were returned are still read from them."""
        self._commit([self._written(self.runs().groupBy("bucket").applyInPandas(_compacted, _ENTRY))], [*self.state["old"], *self.state["runs"]])

    def vacuum(self) -> None:
        """Remove the runs that others have replaced; for when no hits of earlier batches are read any more."""
        for name in self.state["old"]:
            self._fs.delete(self._path(name), True)
        self._commit(self.state["runs"], [])

    @staticmethod
    def _places(packed: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for u, p in zip(b["uid"].to_pylist(), b["pos"].to_pylist(), strict=True):
                    for at in range(0, len(u), 8 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(u[at : at + (8 << 16)], np.int64)), pa.array(np.frombuffer(p[at // 2 : at // 2 + (4 << 16)], np.int32))], ["uid", "pos"])

        return packed.mapInArrow(run, "uid long, pos int")


_WINDOWS = "bucket int, kind int, key binary, uid binary, pos binary, size binary, seq binary"
_WNAMES, _WTYPES = [*_NAMES, "size", "seq"], [*_TYPES, pa.binary(), pa.binary()]


def windows(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Windows of repeated anchors, packed by bucket of the anchor: stretches (anchor, uid, first window, number) and a 64-bit hash of each window's words.

    A stretch that a task sees twice (anchor and a hash of all its windows are equal) is covered at once (HIT rows: uid, first, number), and stands once without a place."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        key, uid, pos, size, seq = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            whole = mix(np.add.reduceat(mix(seq + np.arange(len(seq), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)), at) + size.astype(np.uint64))
        order = np.lexsort((key, whole))
        first = np.flatnonzero(np.concatenate(([True], (whole[order][1:] != whole[order][:-1]) | (key[order][1:] != key[order][:-1]))))
        n = np.diff(np.append(first, len(order)))
        many = order[np.repeat(n > 1, n)]
        rows = [(0, HIT, b"", uid[many].tobytes(), pos[many].tobytes(), size[many].astype(np.int32).tobytes(), b"")]
        one, multi = order[first], n > 1
        for b, k in _parts_of((mix(key[one]) % np.uint64(buckets)).astype(np.int64)):
            x = one[k]
            pick = np.repeat(at[x], size[x]) + np.arange(size[x].sum()) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
            rows.append((b, RUN, key[x].tobytes(), uid[x].tobytes(), np.where(multi[k], _NONE, pos[x]).astype(np.int32).tobytes(), size[x].astype(np.int32).tobytes(), seq[pick].tobytes()))
        return _frame(rows, _WNAMES, _WTYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for b in batches:
            uids, hot = np.empty(b.num_rows, _DOC), b["hot"]
            uids["a"], uids["b"] = b["uid"].to_numpy(), b["uid2"].to_numpy()
            for lo, _, data, off in slices(b["text"]):
                starts, ends, ptr = words(data, off)
                h = word_hashes(data, starts, ends)
                h2 = word_hashes(data, starts, ends, seed=12)
                for d in np.flatnonzero(np.diff(ptr) >= window).tolist():
                    own = slice(ptr[d], ptr[d + 1])
                    g, at = anchors(h[own], window, gram)
                    sel = np.isin(at, np.asarray(hot[lo + d].values))
                    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    size = np.diff(np.append(first, len(at)))
                    keep = sel[first]
                    first, size = first[keep], size[keep]
                    if len(first):
                        seq = gram_hashes(h2[own], window, seed=12)[np.repeat(keep, np.diff(np.append(np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), len(at))))]
                        held.append((g[at[first]], np.repeat(uids[lo + d : lo + d + 1], len(first)), first.astype(np.int32), size, seq))
                        total += len(seq)
                if total > FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, _WINDOWS)


def _again(packed: DataFrame) -> DataFrame:
    """Packed stretches (with `parts`) as packed windows, dealt by the windows' hashes: bucket, sub and what _verified() takes."""
    names = ["bucket", "sub", "key", "uid", "pos", "size", "seq"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k].as_py() for c in ("bucket", "parts", *names[2:])}
                key, uid, pos, size, seq = (np.frombuffer(row[c], t) for c, t in (("key", np.uint64), ("uid", _DOC), ("pos", np.int32), ("size", np.int32), ("seq", np.uint64)))
                of = np.repeat(np.arange(len(size)), size)
                nth = np.arange(len(seq)) - np.repeat(np.cumsum(size) - size, size)
                at = np.where(pos[of] < 0, _NONE, pos[of] + nth).astype(np.int32)
                out = []
                for sub, w in _parts_of((mix(seq) % np.uint64(row["parts"])).astype(np.int64)):
                    out.append((row["bucket"], sub, key[of[w]].tobytes(), uid[of[w]].tobytes(), at[w].tobytes(), np.ones(len(w), np.int32).tobytes(), seq[w].tobytes()))
                yield _frame(out, names, types)

    return packed.mapInArrow(run, "bucket int, sub int, key binary, uid binary, pos binary, size binary, seq binary")


_COVER = "uid long, uid2 long, first int, n int"


def _verified(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket the stretches of windows that occur twice: uid, uid2, first, number."""
    join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
    key, uid, pos, size, seq = join("key", np.uint64), join("uid", _DOC), join("pos", np.int32), join("size", np.int32).astype(np.int64), join("seq", np.uint64)
    # an eighth of a bucket's windows is sorted at a time: equal ones fall into the same
    twice = np.zeros(len(seq), bool)
    part = (seq >> np.uint64(61)).astype(np.uint8)
    stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
    for eighth in range(8):
        at = np.flatnonzero(part == eighth)
        s, k = seq[at], key[stretch[at]]
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        same = np.flatnonzero((s[1:] == s[:-1]) & (k[1:] == k[:-1]))
        twice[at[order[same]]] = twice[at[order[same + 1]]] = True
    del part, stretch
    # a stretch without a place stands for several, which are covered: what equals one of its windows repeats
    twice &= np.repeat(pos >= 0, size)
    at = np.flatnonzero(twice)
    ends = np.cumsum(size)
    of = np.searchsorted(ends, at, "right")
    u, p = uid[of], pos[of] + at - (ends - size)[of]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(p) != 1) | (u[1:] != u[:-1])))) if len(at) else at
    return pd.DataFrame({"uid": u["a"][first], "uid2": u["b"][first], "first": p[first].astype(np.int32), "n": np.diff(np.append(first, len(at))).astype(np.int32)})


def _stretches(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, p, s in zip(b["uid"].to_pylist(), b["pos"].to_pylist(), b["size"].to_pylist(), strict=True):
                docs = np.frombuffer(u, _DOC)
                yield pa.RecordBatch.from_arrays([pa.array(docs["a"].copy()), pa.array(docs["b"].copy()), pa.array(np.frombuffer(p, np.int32)), pa.array(np.frombuffer(s, np.int32))], ["uid", "uid2", "first", "n"])

    return packed.mapInArrow(run, _COVER)


def uids() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("uid"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("uid2")


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) with cover: array<struct<first, n>>, the repeated windows of each (null: none). The index, kept at `path` if one is given, takes them in `batches` batches."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", *uids(), "text")
    log = FingerprintLog(spark, path, None if path else buckets_for(docs), window, gram)
    hits = None
    for k in range(batches):
        found = log.append(keyed.where(F.pmod(F.col("uid"), F.lit(batches)) == k).select("uid", "text"))
        hits = found if hits is None else hits.unionByName(found)
    hot = hits.groupBy("uid").agg(F.collect_set("pos").alias("hot"))
    packed = windows(keyed.join(hot.hint("shuffle_hash"), "uid").select("uid", "uid2", "text", "hot"), log.buckets, window, gram)
    sent = cut(packed)
    runs = sent.where(F.col("kind") == RUN)
    sizes = runs.groupBy("bucket").agg(F.sum(F.octet_length("seq")).alias("bytes"))
    mean = max(1.0, (sizes.agg(F.sum("bytes")).first()[0] or 0) / log.buckets)
    large = cut(sizes.where(F.col("bytes") > HOT * mean).select("bucket", F.ceil(F.col("bytes") / mean).cast("int").alias("parts")))
    found = runs.join(large, "bucket", "left_anti").groupBy("bucket").applyInPandas(_verified, _COVER)
    spread = _again(runs.join(large, "bucket").select("bucket", "parts", "key", "uid", "pos", "size", "seq")).groupBy("bucket", "sub").applyInPandas(_verified, _COVER)
    all_ = found.unionByName(spread).unionByName(_stretches(sent.where(F.col("kind") == HIT)))
    cover = all_.groupBy("uid", "uid2").agg(F.collect_set(F.struct("first", "n")).alias("cover"))
    return keyed.join(cover.hint("shuffle_hash"), ["uid", "uid2"], "left").select("doc_id", "text", "cover")


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left of the text, words joined by one space) of every row of docs."""
    marked = covered(ids_and_texts(docs, id_col, text_col), window, gram, batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            data, off = utf8(b["text"].cast(pa.binary()))
            raw = data.tobytes() if len(off) < 2 else data[off[0] : off[-1]].tobytes()
            total, gone, kept = [], [], []
            for k, cover in enumerate(b["cover"].to_pylist()):
                ws = raw[off[k] - off[0] : off[k + 1] - off[0]].split()
                n = len(ws)
                if cover:
                    mark = np.zeros(n + 1, np.int64)
                    first = np.array([c["first"] for c in cover])
                    last = first + np.array([c["n"] for c in cover]) + window - 1
                    np.add.at(mark, first, 1)
                    np.add.at(mark, last, -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                total.append(n)
                gone.append(n - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_ = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut_.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
