"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the mixture times the mixture's size, over its own size. Each document
inverts the Poisson distribution with that mean at a uniform number hashed from its id (a mean beyond MOST_RATE is dealt over
several independent numbers, whose counts add up), is exploded by the count, and every copy gets a hashed key that says where
it stands in the global shuffle. That key is uniform, so partitions are equal ranges of it, and nothing is sampled to find them.

Defined results: a null source is a source of its own (named ''); a source without a target gets none; null, empty and very long
texts count as documents and are copied whole; rows that repeat an id repeat its count and its copies' keys, and a null id is an id as others
are; ties of keys stand in any order; an empty table gives no rows. What is added takes one more underscore for each that the table already has
such a column (names()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import columns, cut, free, parts, row

#: Shares follow size^TEMPERATURE unless they are given.
TEMPERATURE, SEED = 0.5, 17
#: The mean that one hashed number is inverted at, at most; a hashed number has 48 bits.
MOST_RATE, BITS = 16.0, 48
#: Sources whose rates are broadcast at most; parts of a source beyond that.
BROADCAST, SALTS = 10_000, 64
#: Terms of the inversion: beyond these no number of 48 bits is left at MOST_RATE.
TERMS = 72


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1): the first 48 bits of an MD5 over seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(1 << BITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, source_col: str = "source") -> DataFrame:
    """source_key, n, rate: one row for each source. weights: share by source (need not sum to 1); size: documents wanted, as many as there are by default."""
    n = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source_key string, w double")
        n = n.join(given, "source_key", "left").na.fill(0.0, ["w"])
    total = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if size is None else F.lit(float(size))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * wanted / F.col("n")).otherwise(0.0)
    return n.join(F.broadcast(total)).select("source_key", "n", rate.alias("rate"))


def poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability exceeds u: terms are summed until they pass it."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), start,
        lambda s, i: F.when(u < s["c"], s).otherwise(F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), (s["k"] + 1).alias("k"))),
    )
    return done["k"]


def repeats(seed: int, key: Column, rate: Column) -> Column:
    """A Poisson count of any mean: the sum of as many counts, each of an equal part of it, as keep a part within MOST_RATE."""
    draws = F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")
    part = rate / draws
    more = F.aggregate(F.sequence(F.lit(2), draws), F.lit(0), lambda s, i: s + poisson(uniform(seed, key, i), part))
    return poisson(uniform(seed, key), part) + F.when(draws > 1, more).otherwise(0)


def names(docs: DataFrame) -> tuple[str, str]:
    """What mix() calls the copy's number and its place."""
    return free(docs, "_copy"), free(docs, "_order")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, each row as often as its count says, with _copy (from 0) and _order (hex key of the global shuffle).

    The rates, a row for each source, are broadcast if there are BROADCAST at most (they are counted); beyond that both sides are salted."""
    table = cut(rates(docs, weights, size, source_col)).select("source_key", "rate")
    keyed = docs.select(row(docs).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"))
    if table.count() <= BROADCAST:
        joined = keyed.join(F.broadcast(table), "source_key")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", salt).join(spread, ["source_key", "salt"])
    counted = joined.select("row", "id", repeats(seed, F.col("id"), F.col("rate")).alias("times"))
    copies = counted.where("times > 0").select("row", "id", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    copy, place = names(docs)
    return copies.select(*columns(docs, "row"), F.col("copy").alias(copy), order.alias(place))


def shuffled(mixed: DataFrame, order: str = "_order") -> DataFrame:
    """Rows of mix() in the order of their keys: partitions are equal ranges of these, each sorted."""
    n = parts(mixed.sparkSession)
    place = F.conv(F.substring(order, 1, BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(1 << BITS))
    return mixed.repartitionById(n, F.floor(place * n).cast("int")).sortWithinPartitions(order)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return shuffled(mix(docs)).select("doc_id", "text", "lang", "source", F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


OP2_SQL = f"""
WITH n AS (SELECT coalesce(source, '') AS k, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT k, n, pow(n::DOUBLE, {TEMPERATURE}) AS w FROM n),
t AS (SELECT sum(w) AS aw, sum(n)::DOUBLE AS an FROM w),
r AS (SELECT k, w / aw * an / n AS rate, greatest(ceil(w / aw * an / n / {MOST_RATE}), 1)::INTEGER AS draws FROM w, t),
terms AS (
  WITH RECURSIVE s AS (
    SELECT k, rate / draws AS rate, 0 AS i, exp(-rate / draws) AS p, exp(-rate / draws) AS c FROM r
    UNION ALL SELECT k, rate, i + 1, p * rate / (i + 1), c + p * rate / (i + 1) FROM s WHERE i < {TERMS - 1})
  SELECT * FROM s),
d AS (SELECT row_number() OVER () AS z, doc_id, text, lang, source, coalesce(source, '') AS k, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
u AS (SELECT z, d.k, ('0x' || substr(md5('{SEED}:' || id || CASE WHEN g.i > 1 THEN ':' || g.i ELSE '' END), 1, {BITS // 4}))::BIGINT::DOUBLE / {float(1 << BITS)} AS u
  FROM d JOIN r ON r.k = d.k, unnest(range(1, r.draws + 1)) AS g(i)),
m AS (SELECT z, count(*) AS times FROM u JOIN terms t ON t.k = u.k AND u.u >= t.c GROUP BY z)
SELECT d.doc_id, d.text, d.lang, d.source, c.i::INTEGER AS copy, md5('{SEED}:order:' || d.id || ':' || c.i) AS shuffle_key
FROM d JOIN m ON m.z = d.z, unnest(range(0, m.times)) AS c(i)
"""
