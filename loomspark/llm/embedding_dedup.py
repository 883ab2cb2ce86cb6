"""Embedding near-duplicates: spherical k-means cells, and blocked cosine products within them.

Equal vectors of a label are folded into one class with its count, known by the number of one of its rows. Each vector goes to the cell of its nearest
centroid (there it is at home), and as a guest to every cell whose dividing plane is within half the largest distance that a link
can span, d = sqrt(2 - 2 cosine): of two linked vectors in different cells one at least is that close to the plane between them, so
it is a guest in the other's cell, and no link is lost. In many dimensions almost all cells are that near. A cell's own rows meet
each other and its guests in blocks of BLOCK rows, guests never each other; a pair of blocks gives one row for a vector at most
(its links there, and the least id it hangs together with), however many links there are.

Defined results: every row of the table gives one row. A vector that is null, empty or zero, or holds a null or non-finite
component, or has a null label, links with nothing and stands for itself; vectors of different lengths never link, whatever their
labels; labels of any type are compared as they are (1.2 and 1.7 differ); repeated rows link with each other; rows that repeat an id
share a component, and each counts its own links; a row with a null id links with nothing, has no component and is kept; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import components, cut, prepare

COSINE = 0.93
#: Rows that the centroids are fitted on, vectors for each cell and cells at most, rows of a block.
FIT_ROWS, PER_CELL, CELLS, BLOCK = 8192, 8000, 1024, 1024
SCHEMA = "grp string, dim int, cell int, own boolean, id long, n long, home int, cells binary, vector binary"


def valid(embedding: str = "embedding") -> Column:
    v = F.col(embedding)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def unit(rows: list) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroids are the first different rows."""
    c = np.unique(sample.round(9), axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(rounds):
        home = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1)
        c = np.where((norm > 1e-9)[:, None], total / np.maximum(norm, 1e-9)[:, None], c)
    return np.unique(c.round(12), axis=0)


def cells_of(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and a mask of all cells that it goes to."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12))
    near = (dots[np.arange(len(x)), home][:, None] - dots) / apart[home] <= reach
    near[np.arange(len(x)), home] = True
    return home, near


def least_met(adj: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows a and columns b of a link matrix the least id that each hangs together with."""
    big = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(adj, b[None, :], big).min(axis=1, initial=big))
        b2 = np.minimum(b, np.where(adj, a2[:, None], big).min(axis=0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def linked(vectors: DataFrame, cosine: float = COSINE, single: bool = False) -> DataFrame:
    """vectors: id, grp, n (how many it stands for), embedding. Returns id, n_links (counting copies of others), least (an id it hangs together with).

    single: all components are single-precision numbers, and travel as such."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = np.dtype(np.float32 if single else np.float64)
    # lengths with more vectors than fill a cell have centroids of their own
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * PER_CELL).collect()
    by_dim = {}
    for d, n in sizes:
        rows = vectors.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("embedding").collect()
        by_dim[d] = centroids(unit([r.embedding for r in rows]), int(min(CELLS, n // PER_CELL)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-6)

    def assign(batches):
        for df in batches:
            for d, part in df.groupby(df["embedding"].map(len)):
                c = by_dim.get(d, np.ones((1, d)) / np.sqrt(d))
                home, near = cells_of(unit(part["embedding"].tolist()), c, reach)
                raw = [np.asarray(v, kind).tobytes() for v in part["embedding"]]
                goes = [np.flatnonzero(m).astype(np.int32).tobytes() for m in near]
                row, cell = np.nonzero(near)
                own = cell == home[row]
                out = part.iloc[row]
                # where a row goes counts at its home alone
                yield pd.DataFrame({"grp": out["grp"].to_numpy(), "dim": np.int32(d), "cell": cell.astype(np.int32), "own": own, "id": out["id"].to_numpy(), "n": out["n"].to_numpy(), "home": home[row].astype(np.int32), "cells": [goes[i] if o else b"" for i, o in zip(row, own, strict=True)], "vector": [raw[i] for i in row]})

    held = cut(vectors.select("grp", "id", "n", "embedding").mapInPandas(assign, SCHEMA))
    blocks = lambda what: F.ceil(F.count_if(what) / BLOCK).cast("int")
    sizes = held.groupBy("grp", "dim", "cell").agg(blocks(F.col("own")).alias("owns"), blocks(~F.col("own")).alias("guests")).where("owns > 0")
    hashed = F.xxhash64("id")
    block = F.when(F.col("own"), F.pmod(hashed, "owns")).otherwise(F.col("owns") + F.pmod(hashed, "guests")).cast("int")
    # own blocks meet all blocks of the cell, guests its own ones
    last = F.when(F.col("own"), F.col("owns") + F.col("guests")).otherwise(F.col("owns")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = held.join(sizes, ["grp", "dim", "cell"]).withColumn("block", block).withColumn("pair", F.explode(pairs)).select("grp", "dim", "cell", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "id", "n", "home", "cells", "vector")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = int(df["cell"].iloc[0]), df["i"].iloc[0], df["j"].iloc[0]
        a = df[df["block"] == i]
        b = a if i == j else df[df["block"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n_links": [], "least": []}).astype("int64")
        x, y = (unit([np.frombuffer(v, kind) for v in side["vector"]]) for side in (a, b))
        adj = x @ y.T >= cosine
        if i == j:
            np.fill_diagonal(adj, False)
        # a pair that meets in both home cells counts in the lesser one
        other = b["home"].to_numpy()
        if (other < cell).any():
            goes = np.zeros((len(a), int(max(other.max(), cell)) + 1), bool)
            for r, c in enumerate(a["cells"]):
                c = np.frombuffer(c, np.int32)
                goes[r, c[c < goes.shape[1]]] = True
            adj &= ~(goes[:, other] & (other < cell)[None, :])
        rows, cols = adj.any(axis=1), adj.any(axis=0)
        adj, a, b = adj[np.ix_(rows, cols)], a[rows], b[cols]
        la, lb = least_met(adj, a["id"].to_numpy(), b["id"].to_numpy())
        out = [pd.DataFrame({"id": a["id"].to_numpy(), "n_links": adj @ b["n"].to_numpy(), "least": la})]
        if i != j:
            out.append(pd.DataFrame({"id": b["id"].to_numpy(), "n_links": adj.T @ a["n"].to_numpy(), "least": lb}))
        return pd.concat(out)

    return dealt.groupBy("grp", "dim", "cell", "i", "j").applyInPandas(compare, "id long, n_links long, least long")


def groups(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id of every row of table."""
    kind, label_kind = (table.select(c).dtypes[0][1] for c in (vec_col, label_col))
    label = F.col(label_col)
    if label_kind in ("float", "double"):
        label = F.when(label == 0, F.lit(0.0)).otherwise(label)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("grp"), F.col(vec_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(valid() & F.col("grp").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    keyed = cut(rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.array_join("embedding", ",").cast("binary"), 256))).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(keyed.where("ok").groupBy("grp", "key").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    placed = cut(keyed.where("ok").select("row", "vec_id", "grp", "key").join(classes.select("grp", "key", "id", "n"), ["grp", "key"]).select("row", "vec_id", "id", "n"))
    several = placed.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("vec_id", "a")
    same_id = placed.join(several, "vec_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    found = cut(linked(classes.select("grp", "id", "n", "embedding"), cosine, kind == "array<float>"))
    links = cut(found.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(same_id))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    # a component is known by a row's number; what is returned is the least id of its classes
    named = cut(components(links).withColumnRenamed("node", "id").join(classes.select("id", "least"), "id"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    of_class = classes.select("id", "least").join(counts, "id", "left").join(named, "id", "left").select("id", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component_id", "least").alias("component_id"))
    joined = cut(placed.join(of_class, "id").select("row", "vec_id", (F.col("others") + F.col("n") - 1).alias("n_links"), "component_id"))
    of_id = joined.groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    out = keyed.select("row", "vec_id").join(joined.select("row", "n_links"), "row", "left").join(of_id, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP8_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0 AND NOT list_contains(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)), true)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (SELECT vec_id AS node, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node AND r.c < l.b),
c AS (SELECT node, min(c) AS c FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
