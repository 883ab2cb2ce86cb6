"""Caps, quotas, stratified draws and replay mixes; membership follows a seeded hash, so a seed gives the same rows anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.hashing import order_key


#: Groups whose limits are broadcast at most.
MOST_GROUPS = 10_000


def cap_per_group(df: DataFrame, group: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each group. The rank limit reaches below the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(order_key(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def first_by_hash(df: DataFrame, key: str, quota: DataFrame | int, group: str | None = None, seed: int = 0) -> DataFrame:
    """The first rows in the order of their hashes: `quota` of all, or of each group as many as a table (group, quota) says."""
    return split_by_hash(df, key, quota, group, seed)[0]


def split_by_hash(df: DataFrame, key: str, quota: DataFrame | int, group: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first rows in the order of their hashes, and those of the same groups that are left.

    Rows are counted by group and by the first 16 bits of the hash; that tells which of these cells are taken whole, and only those
    that are cut are sorted, so no task sorts a whole group. Rows of one id in a cut cell are ranked among themselves."""
    g = F.coalesce(F.col(group), F.lit("?")) if group else F.lit("all")
    k = order_key(seed, F.col(key))
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), g.alias("_g"), k.alias("_k"), F.conv(F.substring(k, 1, 4), 16, 10).cast("int").alias("_cell"))
    cells = hashed.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    wanted = quota.select(F.col(quota.columns[0]).alias("_g"), F.col(quota.columns[1]).alias("_q")) if isinstance(quota, DataFrame) else df.sparkSession.range(1).select(F.lit("all").alias("_g"), F.lit(quota).cast("long").alias("_q"))
    w = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(wanted, "_g")
    # of each group: the first cell that is not taken whole, and how many rows of it are
    cut = before.where(F.col("_b") + F.col("_n") > F.col("_q")).groupBy("_g").agg(F.min(F.struct("_cell", (F.col("_q") - F.col("_b")).alias("left"))).alias("_c"))
    limits = wanted.join(cut, "_g", "left").select("_g", F.col("_c._cell").alias("_end"), F.col("_c")["left"].alias("_left"))
    few = limits.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS:
        # counted once, and small enough to be sent to all tasks; beyond that the table is joined as it is
        limits = F.broadcast(df.sparkSession.createDataFrame(few, limits.schema))
    placed = hashed.join(limits, "_g")
    at, end = F.col("_cell"), F.col("_end")
    part = placed.where((at == end)).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_k", F.col(f"_row.`{key}`"))))
    first = placed.where(end.isNull() | (at < end)).select("_row.*").unionByName(part.where(F.col("_r") <= F.col("_left")).select("_row.*"))
    return first, placed.where(at > end).select("_row.*").unionByName(part.where(F.col("_r") > F.col("_left")).select("_row.*"))


def places(df: DataFrame, key: str, seed: int = 0, each: int = 1 << 20) -> DataFrame:
    """Places (from 1) in a seeded shuffle: equal ranges of the hash with `each` rows or so are sorted, and their sizes added up."""
    cells = max(1, -(-df.count() // each))
    k = order_key(seed, F.col(key))
    b = df.withColumn("_k", k).withColumn("_b", F.floor(F.conv(F.substring("_k", 1, 12), 16, 10).cast("long") * F.lit(cells) / F.lit(float(1 << 48))).cast("long"))
    before = b.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    r = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k", key))).join(before, "_b")
    return r.select(*df.columns, (F.col("_r") + F.col("_base")).alias("place"))


def quotas(real: DataFrame, stratum: str, take: int, balance: str = "proportional") -> DataFrame:
    """stratum, n, quota: proportional rounds each share half-even; equal gives the remainder to the first strata in order; a pool that is too small gives all."""
    n = real.groupBy(F.coalesce(F.col(stratum), F.lit("?")).alias("stratum")).agg(F.count("*").alias("n"))
    if balance == "proportional":
        total = n.agg(F.sum("n").alias("total"))
        q = n.join(F.broadcast(total)).withColumn("q", F.bround(take * F.col("n") / F.col("total")).cast("long"))
    elif balance == "equal":
        total = n.agg(F.count("*").alias("k"))
        rank = F.row_number().over(Window.orderBy("stratum"))
        q = n.withColumn("i", rank).join(F.broadcast(total)).withColumn("q", F.floor(F.lit(take) / F.col("k")) + F.when(F.col("i") <= F.lit(take) % F.col("k"), 1).otherwise(0))
    else:
        raise ValueError(f"unknown balance {balance!r}: proportional or equal")
    return q.select("stratum", "n", F.least("q", "n").alias("quota"))


def stratified_sample(real: DataFrame, stratum: str, key: str, take: int, balance: str = "proportional", seed: int = 0) -> DataFrame:
    """take rows by quota; what small pools leave short is drawn uniformly from the rest, by row, never with replacement."""
    q = quotas(real, stratum, take, balance)
    chosen, rest = split_by_hash(real, key, q.select("stratum", "quota"), stratum, seed)
    missing = max(0, take - int(q.agg(F.sum("quota")).first()[0] or 0))
    return chosen.unionByName(first_by_hash(rest, key, missing, None, seed + 1)) if missing else chosen


def mix(synthetic: DataFrame, real: DataFrame, stratum: str, key: str, ratio: float = 1.0, balance: str = "proportional", seed: int = 0, shuffle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows and a replay draw of round(n * ratio) real ones, all of them if there are no more; and a report of one row."""
    if ratio < 0:
        raise ValueError("ratio can't be negative")
    n_syn, n_real = synthetic.count(), real.count()
    want = round(n_syn * ratio)
    used = real if want >= n_real else stratified_sample(real, stratum, key, want, balance, seed)
    rows = synthetic.withColumn("_part", F.lit(0)).unionByName(used.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    if shuffle:
        rows = rows.orderBy(order_key(seed, F.concat_ws(":", "_part", key)))
    by = lambda df, name: df.groupBy(F.coalesce(F.col(stratum), F.lit("?")).alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias(name))
    report = by(used, "used_by_source").join(by(real, "available_by_source")).select(
        F.lit(n_syn).alias("synthetic"), F.lit(n_real).alias("available"), F.lit(want).alias("requested"), F.lit(min(want, n_real)).alias("used"),
        F.lit(want >= n_real).alias("capped"), F.lit("all-used" if want >= n_real else balance).alias("mode"), F.lit(ratio).alias("requested_ratio"), F.lit(round(min(want, n_real) / max(n_syn, 1), 4)).alias("achieved_ratio"),
        F.lit(n_syn + min(want, n_real)).alias("total"), "used_by_source", "available_by_source",
    )
    return rows.drop("_part"), report


def describe_mix(report: DataFrame) -> str:
    r = report.first()
    lines = [f"{r.total:,} pairs: {r.synthetic:,} synthetic and {r.used:,} of {r.available:,} real ({r['mode']})", f"replay ratio {r.achieved_ratio} of {r.requested_ratio} requested"]
    lines += [f"  {k}: {v:,} of {r.available_by_source[k]:,}" for k, v in sorted(r.used_by_source.items())]
    return "\n".join(lines)


def machine_cap(rows: DataFrame, source: str, human: list, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """All human rows, and floor(ratio * human) of the others by hash."""
    people = rows.where(F.col(source).isin(human))
    most = int(people.count() * ratio)
    return people.unionByName(first_by_hash(rows.where(~F.col(source).isin(human)), key, most, None, seed))


def clean_ref_augment(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds copies of rows with reference units whose source is the reference: origin clean-ref, int(n * ratio) or as many as there are."""
    pool = rows.where(F.col("reference_units").isNotNull() & (F.col("reference_units") != ""))
    want = min(int(rows.count() * ratio), pool.count())
    extra = first_by_hash(pool, key, want, None, seed).withColumn("source_text", F.replace("reference_units", F.lit(" "), F.lit(""))).withColumn("origin", F.lit("clean-ref"))
    return rows.unionByName(extra.select(*rows.columns))


def length_batches(df: DataFrame, group: str, length: str, key: str, budget: int) -> DataFrame:
    """Greedy batches of each group, shortest rows first, whose padded size stays within the budget: _batch.

    Only how many rows have each length matters: of a group's different lengths in order it follows where each begins, and
    a row's batch from its rank within its length."""
    rows = df.withColumn("_n", F.col(length).cast("long"))
    counts = rows.groupBy(group, "_n").agg(F.count("*").cast("long").alias("m")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", "m"))).alias("sizes"))
    zero = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<n:bigint,b:bigint,c:bigint,most:bigint>>").alias("out"))

    def step(s, x):
        most = F.when(x["_n"] > 0, F.greatest(F.floor(F.lit(budget) / F.greatest(x["_n"], F.lit(1))), F.lit(1))).otherwise(F.lit(2**40)).cast("long")
        full = s["c"] >= most
        b, c = F.when(full, s["b"] + 1).otherwise(s["b"]), F.when(full, F.lit(0).cast("long")).otherwise(s["c"])
        more = F.floor((c + x["m"] - 1) / most)
        begun = F.array(F.struct(x["_n"].alias("n"), b.alias("b"), c.alias("c"), most.alias("most")))
        return F.struct((b + more).alias("b"), (c + x["m"] - more * most).alias("c"), F.concat(s["out"], begun).alias("out"))

    begin = counts.select(F.col(group).alias("_g"), F.explode(F.aggregate("sizes", zero, step)["out"]).alias("x")).select("_g", F.col("x.n").alias("_l"), "x.b", "x.c", "x.most")
    rank = F.row_number().over(Window.partitionBy(group, "_n").orderBy(key)) - 1
    j = rows.withColumn("_r", rank).join(begin, F.col(group).eqNullSafe(F.col("_g")) & F.col("_n").eqNullSafe(F.col("_l")))
    return j.select(group, key, F.col("_n").alias(length), (F.col("b") + F.floor((F.col("c") + F.col("_r")) / F.col("most"))).cast("int").alias("_batch"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset.. of an order: what comes before the costly part of a plan."""
    return df.orderBy(*order).offset(offset).limit(limit)


def first_kept(df: DataFrame, keep: Column, order: list[str], n: int) -> DataFrame:
    """The first n rows of an order that pass: the limit counts kept rows."""
    return df.where(keep).orderBy(*order).limit(n)


def sample_published(rows: DataFrame, source: str, key: str, take: int, order: str, seed: int = 0, each: int = 4) -> DataFrame:
    """take rows of all sources in proportion; each source's pool is its first each * take rows by `order`, as they were published."""
    w = Window.partitionBy(source).orderBy(order, key)
    pool = rows.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= each * take).drop("_p")
    n = rows.groupBy(F.coalesce(F.col(source), F.lit("?")).alias("g")).agg(F.count("*").alias("n"))
    q = n.join(n.agg(F.sum("n").alias("t"))).select("g", F.bround(take * F.col("n") / F.col("t")).cast("long").alias("q"))
    return first_by_hash(pool, key, q, source, seed)


def jobs(registry: DataFrame, smoke: bool = False) -> DataFrame:
    """registry (split, shards, target) to one row a shard: split, shard, shards, cap = ceil(target / shards), none without a target; a smoke run takes each split's first."""
    each = registry.where("shards > 0").select("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"), F.col("shards").cast("long").alias("shards"), F.ceil(F.col("target") / F.col("shards")).cast("long").alias("cap"))
    return each.where("shard = 0") if smoke else each


def samples(rows: DataFrame, order: list[str], n: int = 5, width: int = 80) -> DataFrame:
    """The first n rows for a report, strings cut to width."""
    return rows.orderBy(*order).limit(n).select(*[F.left(F.col(c), F.lit(width)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
