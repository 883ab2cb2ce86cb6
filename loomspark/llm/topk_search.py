"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers. Each is keyed by its nearest home pivot and its distance to it; annuli of equal counts around a home
are its cells. A cell knows, for every pivot, the least and largest distance of its vectors, and their largest norm. For a
query q three bounds hold for all v of a cell: q.v <= |q| |v|; q.v = q.p + q.(v - p) <= q.p + |q| |v - p| for each pivot p; and by the triangle
inequality |q - v| >= the gap between |q - p| and the cell's distances to p, so q.v <= (|q|^2 + |v|^2 - gap^2) / 2 with the largest
gap over all pivots. A query first expands the cells of best bounds until they hold enough candidates; its k-th best
score there then stops it from every cell whose bound is below.

Queries are dealt into blocks by their home, so that those of a block want the same cells; a cell's vectors are sent
to the blocks that want it, and to no others. Pivots and cells, of bounded number, are on the driver. The index prunes what has
structure (share_visited() tells how much is compared); in many dimensions, vectors without any are compared with nearly all.

Defined results: vectors that are null or hold a null or non-finite component take no part; an empty or zero vector scores
0; vectors of different lengths are compared as if padded with zeros; repeated rows are candidates each, but never of their own id,
and an id that repeats among the queries asks with its least vector (by bytes); ties go to the smaller id; components of any finite size
are compared exactly, and a score beyond a long is returned as the nearest long; an empty table gives no rows. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._common import binaries, cut, prepare, utf8

K, EVERY, SCALE = 10, 100, 1024
#: Rows the pivots are drawn from, pivots, rows of a cell (until CELLS are reached), vectors and queries of a block.
FIT_ROWS, PIVOTS, CELL, CELLS, BLOCK, QUERIES = 4096, 64, 512, 4096, 16384, 4096
#: Vectors with a larger integer are in no annulus: every query meets them, and they meet every cell.
VAST = 2.0**400
LEAST, MOST = -(2**63), 2**63 - 1


def whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x.astype(np.float64))


def exact(x: np.ndarray) -> list[int]:
    return [int(v) if np.isfinite(v) else SCALE * int(r) for v, r in zip(whole(x), x, strict=True)]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of the integers of raw vectors: doubles where no sum can pass 2^53, else 64-bit integers, else Python's."""
    a, b = whole(q), whole(v)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    right = [exact(y) for y in v]
    out = np.empty((len(q), len(v)), object)
    for i, x in enumerate(q):
        left = exact(x)
        out[i] = [sum(m * n for m, n in zip(left, y, strict=True)) for y in right]
    return out


def beyond(score: int) -> bytes | None:
    """Of a score beyond a long, bytes that sort as the scores do, around b"\\x01" for those within."""
    if LEAST <= score <= MOST:
        return None
    size = abs(score).bit_length() // 8 + 1
    raw = size.to_bytes(8, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + raw if score > 0 else b"\x00" + bytes(255 - c for c in raw)


def rows_of(array: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """Vectors of `width` numbers, one binary each, as a matrix; no copy."""
    data, off = utf8(array)
    return data[off[0] : off[-1]].view(kind).reshape(len(off) - 1, width)


def padded(lists: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    out = np.zeros((len(size), width), kind)
    inside = np.arange(width) < size[:, None]
    out[inside] = flat[off[0] : off[-1]]
    return out


def spread(sample: np.ndarray, n: int, seed: int = 9) -> np.ndarray:
    """Pivots drawn one after another, each in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    out = [sample[int(rng.integers(len(sample)))]]
    apart = ((sample - out[0]) ** 2).sum(axis=1)
    while len(out) < n and (total := apart.sum()) > 0:
        out.append(sample[min(int(np.searchsorted(np.cumsum(apart), rng.random() * total, "right")), len(sample) - 1)])
        apart = np.minimum(apart, ((sample - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


class Index:
    """Stored vectors (id, cell, x) and, of each cell, the number of its rows and the bounds of its distances and norms."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        self.spark = table.sparkSession
        prepare(self.spark)
        self.kind = kind = np.dtype(np.float32 if table.select(vec_col).dtypes[0][1] == "array<float>" else np.float64)
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == np.float32 else "array<double>").alias("v"))
        rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
        self.width = width = max(1, width or 1)
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select(F.col("v").cast("array<double>").alias("v")).toArrow()["v"]
        sample = whole(np.concatenate([padded(c, np.dtype(float), width) for c in drawn.chunks]) if len(drawn) else np.zeros((1, width)))
        sample = sample[np.abs(sample).max(axis=1) <= VAST]
        self.pivots = pivots = spread(sample if len(sample) else np.zeros((1, width)), PIVOTS)
        cells = min(CELLS, max(1, n // CELL))
        rings = max(1, round(cells**0.5))
        homes = pivots[: max(1, -(-cells // rings))]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = padded(b["v"], kind, width)
                v = whole(x)
                vast = np.abs(v).max(axis=1) > VAST
                v[vast] = 0
                home = ((homes * homes).sum(axis=1) - 2 * v @ homes.T).argmin(axis=1).astype(np.int32)
                r = np.where(vast, 0, np.linalg.norm(v - homes[home], axis=1))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.where(vast, -1, home).astype(np.int32)), pa.array(r), binaries([a.tobytes() for a in x])], ["id", "home", "r", "x"])

        placed = cut(rows.mapInArrow(place, "id long, home int, r double, x binary"))
        at = [k / rings for k in range(1, rings)]
        edges = {r.home: r.e for r in placed.groupBy("home").agg(F.percentile_approx("r", at, 10000).alias("e")).collect()} if at else {}
        ring = F.lit(0)
        if edges:
            known = F.create_map(*[F.lit(z) for h, e in edges.items() for z in (h, e)])
            ring = F.size(F.filter(known[F.col("home")], lambda e: e < F.col("r")))
        self.rows = placed.select("id", F.when(F.col("home") < 0, -1).otherwise(F.col("home") * rings + ring).cast("int").alias("cell"), "home", "x")
        self._measure()

    def _measure(self) -> None:
        pivots, kind, width = self.pivots, self.kind, self.width
        many = len(pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                cell = b["cell"].to_numpy()
                v = whole(rows_of(b["x"], kind, width))
                v[cell < 0] = 0
                for c in np.unique(cell).tolist():
                    some = v[cell == c]
                    d = distances(some, pivots)
                    lo, hi, norm, n = held.get(c, (np.inf, -np.inf, 0.0, 0))
                    held[c] = [np.minimum(lo, d.min(axis=0)), np.maximum(hi, d.max(axis=0)), max(norm, float(np.linalg.norm(some, axis=1).max())), n + len(some)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), binaries([h[0].tobytes() for h in held.values()]), binaries([h[1].tobytes() for h in held.values()]), pa.array([h[2] for h in held.values()], pa.float64()), pa.array([h[3] for h in held.values()], pa.int64())], ["cell", "lo", "hi", "norm", "n"])

        def merge(t: pa.Table) -> pa.Table:
            lo, hi = (np.array([np.frombuffer(x) for x in t[c].to_pylist()]).reshape(-1, many) for c in ("lo", "hi"))
            return pa.table({"cell": t["cell"].slice(0, 1), "lo": binaries([lo.min(axis=0).tobytes()]), "hi": binaries([hi.max(axis=0).tobytes()]), "norm": [max(t["norm"].to_pylist())], "n": [sum(t["n"].to_pylist())]})

        kinds = "cell int, lo binary, hi binary, norm double, n long"
        found = self.rows.select("cell", "x").mapInArrow(run, kinds).groupBy("cell").applyInArrow(merge, kinds).orderBy("cell").collect()
        self.cell = np.array([r.cell for r in found], np.int64)
        self.n = np.array([r.n for r in found], np.int64)
        self.norm = np.array([r.norm for r in found], float)
        self.lo, self.hi = (np.array([np.frombuffer(bytes(r[c])) for r in found]).reshape(-1, many) for c in ("lo", "hi"))

    def bounds(self, raw: np.ndarray) -> np.ndarray:
        """For each query and cell, what no inner product there exceeds."""
        q = whole(raw)
        vast = np.abs(q).max(axis=1, initial=0) > VAST
        q[vast] = 0
        size = np.linalg.norm(q, axis=1)[:, None]
        d, dots = distances(q, self.pivots), q @ self.pivots.T
        gap = np.zeros((len(q), len(self.cell)))
        least = size * self.norm
        for j in range(len(self.pivots)):
            gap = np.maximum(gap, np.maximum(d[:, j, None] - self.hi[:, j], self.lo[:, j] - d[:, j, None]))
            least = np.minimum(least, dots[:, j, None] + size * self.hi[:, j])
        squares = size**2 + self.norm**2
        out = np.minimum(least, (squares - gap**2) / 2) + 1e-9 * (squares + size * self.hi.max(axis=1, initial=0)) + 1
        out[:, self.cell < 0] = np.inf
        out[vast] = np.inf
        return out

    def opening(self, bound: np.ndarray, k: int) -> np.ndarray:
        """Mask of the cells that a query expands first: those of best bounds, until they hold some times k candidates."""
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, held < 4 * (k + 1), axis=1)
        return out

    def queries(self, every: int) -> DataFrame:
        """q, qx, block: queries dealt by home, so that a block holds QUERIES or so."""
        asked = self.rows.where(F.col("id") % every == 0).groupBy(F.col("id").alias("q")).agg(F.min(F.struct("x", "home")).alias("m")).select("q", F.col("m.x").alias("qx"), F.col("m.home").alias("home"))
        asked = cut(asked)
        first, blocks, at = [], [], 0
        for r in asked.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect():
            first.append((r.home, at // QUERIES, max(1, -(-r.n // QUERIES))))
            blocks.append(r.n)
            at += r.n if r.n < QUERIES else -(-(at + r.n) // QUERIES) * QUERIES - at
        if not first:
            return asked.select("q", "qx", F.lit(0).alias("block"))
        begin, parts = (F.create_map(*[F.lit(z) for f in first for z in (f[0], f[k])])[F.col("home")] for k in (1, 2))
        return asked.select("q", "qx", (begin + F.pmod(F.xxhash64("q"), parts)).cast("int").alias("block"))

    def wanted(self, queries: DataFrame, k: int, rest: bool) -> DataFrame:
        """q, qx, block, floor, cell: the cells that each query opens with, or with `rest` those that its floor leaves beside them."""
        kind, width = self.kind, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    some = b.slice(lo, 256)
                    bound = self.bounds(rows_of(some["qx"], kind, width))
                    go = self.opening(bound, k)
                    if rest:
                        floor = some["floor"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
                        floor[floor <= LEAST] = -np.inf
                        go = ~go & (bound >= floor[:, None] - 1e-12 * np.abs(np.maximum(floor, LEAST))[:, None])
                    r, c = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([*[some[x].take(pa.array(r)) for x in ("q", "qx", "block", "floor")], pa.array(self.cell[c].astype(np.int32))], ["q", "qx", "block", "floor", "cell"])

        # the closure goes to the workers without session and tables
        held = (self.spark, self.rows)
        self.spark = self.rows = None
        try:
            return queries.select("q", "qx", "block", "floor").mapInArrow(run, "q long, qx binary, block int, floor long, cell int")
        finally:
            self.spark, self.rows = held

    def meet(self, wanted: DataFrame, k: int) -> DataFrame:
        """Each query's k best, not below its floor, in each block of its cells: q, id, score, beyond."""
        kind, width = self.kind, self.width
        parts = {int(c): int(-(-n // BLOCK)) for c, n in zip(self.cell, self.n, strict=True)}
        subs = F.coalesce(F.create_map(*[F.lit(z) for kv in parts.items() for z in kv])[F.col("cell")], F.lit(1)) if parts else F.lit(1)
        left = wanted.withColumn("sub", F.explode(F.sequence(F.lit(0), subs - 1)))
        asked = left.groupBy("cell", "sub").agg(F.collect_set("block").alias("blocks"))
        right = self.rows.withColumn("sub", F.pmod(F.xxhash64("id"), subs).cast("int")).join(asked, ["cell", "sub"]).select("cell", "sub", F.explode("blocks").alias("block"), "id", "x")

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            rare: list[bytes | None] = []
            if len(a) and len(b):
                ids = b["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], rows_of(b["x"], kind, width)[order]
                qs, x = a["q"].to_numpy(), rows_of(a["qx"], kind, width)
                floors = a["floor"].fill_null(LEAST).to_numpy()
                for lo in range(0, len(qs), 256):
                    q = qs[lo : lo + 256]
                    s = scores(x[lo : lo + 256], v)
                    floor = floors[lo : lo + 256]
                    go = ((s >= floor[:, None]) | (floor == LEAST)[:, None]) & (ids != q[:, None])
                    if s.dtype != object and len(ids) > k + 1 and np.count_nonzero(go) > 64 * k * len(q):
                        # own rows may be among the best, and are beside them
                        own = int((ids == q[:, None]).sum(axis=1).max())
                        top = min(len(ids), k + own)
                        go &= s >= np.partition(s, len(ids) - top, axis=1)[:, [len(ids) - top]]
                    r, c = np.nonzero(go)
                    if s.dtype == object:
                        ranked = np.array(sorted(range(len(r)), key=lambda z: (r[z], -s[r[z], c[z]], c[z])), np.int64)
                    else:
                        ranked = np.lexsort((c, -s[r, c], r))
                    r, c = r[ranked], c[ranked]
                    nth = np.arange(len(r)) - np.searchsorted(r, r, "left")
                    r, c = r[nth < k], c[nth < k]
                    value = s[r, c]
                    if s.dtype == object:
                        rare += [beyond(z) for z in value]
                        value = np.array([min(max(z, LEAST), MOST) for z in value], np.int64)
                    else:
                        rare += [None] * len(r)
                    out.append((q[r], ids[c], value.astype(np.int64)))
            cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            return pa.table([*map(pa.array, cols), pa.array(rare, pa.binary())], ["q", "id", "score", "beyond"])

        keys = ["cell", "sub", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "q long, id long, score long, beyond binary")

    def search(self, k: int = K, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
        """The k best of each query, and how many rows each compared: (q, id, score, rank) and (q, compared)."""
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit(b"\x01"))), "id")
        top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        queries = self.queries(every).withColumn("floor", F.lit(None).cast("long"))
        first = self.wanted(queries, k, False)
        begun = cut(top(self.meet(first, k)))
        floors = begun.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        then = self.wanted(queries.drop("floor").join(floors, "q", "left"), k, True)
        found = top(begun.drop("rank").unionByName(self.meet(then, k)))
        return found, first.unionByName(then).groupBy("q").agg(F.sum(self._count(F.col("cell"))).alias("compared"))

    def _count(self, cell: Column) -> Column:
        return F.create_map(*[F.lit(int(z)) for kv in [*zip(self.cell, self.n, strict=True), (-2, 0)] for z in kv])[cell]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], axis=1)


def search(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k best others."""
    found, _ = Index(table, id_col, vec_col).search(k, every)
    return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def share_visited(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of all pairs of query and row that a search compares."""
    index = Index(table, id_col, vec_col)
    n, done = index.search(k, every)[1].agg(F.count("*"), F.sum("compared")).first()
    return float(done or 0) / max(1, n * int(index.n.sum()))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
