"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is hashed once; each of BINS bins keeps its least hash, and an empty bin borrows from the bin that a second
hash points it to, again and again until one is full. Bands of ROWS bins are bucket keys: a pair at the threshold
misses all of them with a chance of 3e-6. Equal sets are first folded into one representative. Within a bucket edges form a
star (to the least id, then to the member with most links), so their number is linear in the bucket; each is confirmed
on full sets. What the stars may have left, members of one bucket that are still in different components, then meets in
blocks that count common shingles with matrix products and give a forest, so no link between components is lost: members
outside the bucket's largest component meet all others, members of the largest one never each other.

Defined results: every row of the table gives one row, with the size of its own set. Null and empty texts have an empty set and
link with nothing; fewer words than a shingle are one shingle; repeated rows and equal sets share a component; rows that
repeat an id, whatever their texts, hang together through it and share a component; rows with a null id link with nothing, have
no component and are kept; very long texts count whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import binaries, components, cut, drop, give_back, gram_hashes, ids_and_texts, lean, local_links, mix, prepare, seeds, slices, utf8, word_hashes, words

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Documents of a bucket that are compared with each other at a time.
BLOCK = 512
#: Tries of densification before an empty bin takes the next full one.
TRIES = 64

_TRY = (seeds(TRIES * BINS, 21) % np.uint64(BINS)).astype(np.int64).reshape(TRIES, BINS)
_ROW_KEYS, _BAND_KEYS = seeds(ROWS, 22) | np.uint64(1), seeds(BANDS, 23)
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of n words; A-Z are lower-cased."""
    starts, ends, ptr = words(data, off)
    h = word_hashes(data, starts, ends, lower=True)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(gram_hashes(h[a:b], n)))
        else:
            out.append(mix(gram_hashes(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS least hashes for each set, densified; of an empty set all are _EMPTY."""
    sig = np.full((len(sets), BINS), _EMPTY)
    for row, s in zip(sig, sets, strict=True):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
        row[bins[first].astype(np.int64)] = s[first]
    some = np.flatnonzero([len(s) > 0 for s in sets])
    given = sig[some]
    full = given.copy()
    for k in range(TRIES):
        lack = full == _EMPTY
        if not lack.any():
            break
        full = np.where(lack, given[:, _TRY[k]], full)
    else:
        for row in full:
            at = np.flatnonzero(row != _EMPTY)
            row[:] = row[at[np.searchsorted(at, np.arange(BINS)) % len(at)]]
    sig[some] = full
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sig.reshape(-1, BANDS, ROWS) * _ROW_KEYS).sum(axis=2, dtype=np.uint64) + _BAND_KEYS).view(np.int64)


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """Of docs (doc_id, text_hash, text): doc_id, text_hash, n_shingles, h1, h2 (128 bits that tell sets apart), keys (a bucket key for each band)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in slices(b["text"]):
                sets = shingle_sets(data, off, n)
                keys = band_keys(signatures(sets))
                with np.errstate(over="ignore"):
                    h1 = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64)
                    h2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                cols = [b["doc_id"].slice(lo, hi - lo), b["text_hash"].slice(lo, hi - lo), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "h1", "h2", "keys"])

    return docs.mapInArrow(lean("near_dedup", run), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """Of docs (id, text): id, shingles (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in slices(b["text"]):
                yield pa.RecordBatch.from_arrays([b["id"].slice(lo, hi - lo), binaries([s.tobytes() for s in shingle_sets(data, off, n)])], ["id", "shingles"])

    return docs.mapInArrow(lean("near_dedup", run), "id long, shingles binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of edges (a, b) those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch["sa"]), utf8(batch["sb"])
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = da[oa[k] : oa[k + 1]].view(np.uint64), db[ob[k] : ob[k + 1]].view(np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * same >= percent * (len(both) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return edges.select("a", "b").join(left, "a").join(right, "b").mapInArrow(lean("near_dedup", run), "a long, b long")


def across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket: rows has key, id, component, own (not in the bucket's largest component), owns and others (blocks of own and of other members).

    Own blocks meet all blocks of the bucket, the others own ones alone. A pair of blocks counts all common shingles with one matrix
    product, and gives one row for a document at most: with the least id that its links there lead to."""
    hashed = F.xxhash64("id")
    block = F.when(F.col("own"), F.pmod(hashed, "owns")).otherwise(F.col("owns") + F.pmod(hashed, "others")).cast("int")
    last = F.when(F.col("own"), F.col("owns") + F.col("others")).otherwise(F.col("owns")) - 1
    both = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = rows.withColumn("block", block).withColumn("pair", F.explode(both)).select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "id", "component")

    def compare(table: pa.Table) -> pa.Table:
        ids, comp, side = (table[c].to_numpy() for c in ("id", "component", "block"))
        data, off = utf8(table["shingles"])
        all_ = data[off[0] : off[-1]].view(np.uint64)
        size = np.diff(off) // 8
        row = np.repeat(np.arange(len(ids)), size)
        _, col, times = np.unique(all_, return_inverse=True, return_counts=True)
        use = times[col] > 1
        row, col = row[use], np.unique(col[use], return_inverse=True)[1]
        common = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            part = slice(*np.searchsorted(col, [lo, lo + 4096]))
            m = np.zeros((len(ids), 4096), np.float32)
            m[row[part], col[part] - lo] = 1
            common += m @ m.T
        either = size[:, None] + size[None, :] - common
        adj = (100 * common >= percent * either) & (comp[:, None] != comp[None, :])
        if table["i"][0] != table["j"][0]:
            adj &= side[:, None] != side[None, :]
        some = adj.any(axis=1)
        a = ids[some]
        out = pa.table({"a": a, "b": local_links(adj[np.ix_(some, some)], a) if len(a) else a})
        if len(ids) > BLOCK // 8:
            del all_, row, col, times, use, order, common, either, adj
            give_back()
        return out

    return dealt.join(sets, "id").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def mixed(known: DataFrame) -> DataFrame:
    """Of known (key, id, component) the members of buckets that hold several components, as across() takes them."""
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("c"))
    biggest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    # a table of its own, as classes in groups(): the join can then split hot keys
    wanted = cut(biggest.select("key", F.col("top.component").alias("top"), blocks(F.col("m") - F.col("top.c")).alias("owns"), blocks(F.col("top.c")).alias("others")))
    return known.join(wanted, "key").select("key", "id", "component", (F.col("component") != F.col("top")).alias("own"), "owns", "others")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Equal sets are one class, known by the number of one of its rows; classes are what is linked. An id that stands in
    several classes links them."""
    texts = ids_and_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    sketched = cut(sketch(texts, shingle).withColumn("row", F.monotonically_increasing_id()))
    held = sketched.where("n_shingles > 0 and doc_id is not null")
    # a table of its own: the join below then has an exchange of its own, whose hot classes adaptive execution can split
    classes = cut(held.groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("id"), F.min("doc_id").alias("least")))
    firsts = cut(held.join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "text_hash", "id", "least", F.col("n_shingles").alias("n"), F.when(F.col("row") == F.col("id"), F.col("keys")).alias("keys")))
    leads = firsts.where("keys is not null")
    several = firsts.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    same_id = cut(firsts.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    rows = leads.select("id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("hub"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("c > 1")
    # buckets with the same members are one
    buckets = cut(rows.join(shared.groupBy("c", "x", "y", "hub").agg(F.min("key").alias("key")).select("key", "hub"), "key"))
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))

    stars = buckets.where("id <> hub.id").where(fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    tested = cut(stars)
    wanted = leads.join(buckets.select("id").distinct(), "id", "left_semi").select("doc_id", "text_hash", "id")
    sets = cut(full_sets(texts.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("id", "text"), shingle))
    links = cut(confirmed(tested, sets, percent).unionByName(same_id))
    label = components(links).select(F.col("node").alias("id"), "component")
    known = buckets.select("key", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = known.join(degree, "id", "left").na.fill(0, ["d"])
    hub = cut(ranked.groupBy("key").agg(F.max(F.struct("d", F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("component").alias("ch"))).alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "h.hub", "h.nh", "h.ch"))
    pairs = known.join(hub, "key").where("component <> ch").where(fits(F.col("n"), F.col("nh"))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    more = cut(confirmed(cut(pairs.distinct().join(tested, ["a", "b"], "left_anti")), sets, percent))
    if not more.isEmpty():
        before, links = links, cut(links.unionByName(more))
        drop(before)
        label = components(links).select(F.col("node").alias("id"), "component")
    known = buckets.select("key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = cut(known)
    rest = cut(across(mixed(known), sets, percent))
    if not rest.isEmpty():
        label = components(links.unionByName(rest)).select(F.col("node").alias("id"), "component")
    # a component is known by a row's number; what is returned is the least doc_id of its classes
    linked = cut(label.join(classes.select("id", "least"), "id"))
    drop(same_id, buckets, tested, sets, links, hub, more, known, rest, classes)
    named = linked.select("id", "component").join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    placed = firsts.select("doc_id", "id", "least").join(named, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "least")).alias("component_id"))
    return sketched.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that another document of their group stands for: the least id stays (all rows that hold it). All columns stay."""
    dropped = groups(docs, shingle, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped["_dropped"], "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
