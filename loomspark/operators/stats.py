"""Vocabularies, corpus summaries, percentiles, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def vocabulary(units: DataFrame, min_count: int, min_score: float | None = None) -> DataFrame:
    """units (unit, start, end[, score]) to (class, unit, frames, occurrences): class 0 is <sil>, the others follow by unit."""
    ok = units if min_score is None else units.where(F.col("score") >= min_score)
    kept = ok.groupBy("unit").agg(F.sum(F.col("end") - F.col("start")).alias("frames"), F.count("*").alias("occurrences")).where(F.col("occurrences") >= min_count)
    ranked = kept.select(F.row_number().over(Window.orderBy("unit")).alias("class"), "unit", "frames", "occurrences")
    return ranked.unionByName(units.sparkSession.createDataFrame([(0, "<sil>", 0, 0)], "class int, unit string, frames long, occurrences long"))


def corpus_summary(rows: DataFrame, split: str, size: str, score: str, shard: str) -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("utterances"), F.sum(size).alias("total"), F.avg(score).alias("mean_score"), F.count_distinct(shard).alias("shards"))


def unit_stats(rows: DataFrame, split: str, unit: str, value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """Count, mean, exact percentiles and shares below thresholds, by split and by split and unit, in one pass of grouping sets."""
    v = F.col(value)
    shares = [(F.avg(F.when(v < t, F.lit(1.0)).otherwise(F.lit(0.0))) * 100).alias(f"below_{k}") for k, t in enumerate(thresholds)]
    return rows.groupingSets([[F.col(split)], [F.col(split), F.col(unit)]], split, unit).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.array(*map(F.lit, PERCENTILES))).alias("percentiles"), *shares)


def medians(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """class, median_frames; 0 for a class that never occurs."""
    m = units.groupBy("unit").agg(F.median((F.col("end") - F.col("start")).cast("double")).alias("m"))
    return vocab.join(m, "unit", "left").select("class", F.coalesce("m", F.lit(0.0)).alias("median_frames"))


def histogram(rows: DataFrame, label: str) -> DataFrame:
    """label, n, pct of all."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def norm_stats(rows: DataFrame, array: str) -> DataFrame:
    """Mean and population deviation over all components, variance floored at 1e-8."""
    x = rows.select(F.explode(array).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"), F.lit(1e-8))).alias("std"))


def skip_counts(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def weighted_merge(parts: DataFrame, group: str, mean: str, n: str) -> DataFrame:
    """Means of parts as the mean of the whole."""
    return parts.groupBy(group).agg(F.sum(n).alias("n"), (F.sum(F.col(mean) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias("mean"))


def vocab_remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """unit, status (transferred, new, dropped), old_class, new_class: a full outer join by name."""
    j = old.select("unit", F.col("class").alias("old_class")).join(new.select("unit", F.col("class").alias("new_class")), "unit", "full")
    return j.withColumn("status", F.when(F.col("old_class").isNull(), "new").when(F.col("new_class").isNull(), "dropped").otherwise("transferred"))


def in_vocabulary(units: DataFrame, vocab: DataFrame) -> DataFrame:
    return units.join(vocab.select("unit"), "unit", "left_semi")


def dropped_units(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """unit, occurrences of units that the vocabulary lacks."""
    return units.groupBy("unit").agg(F.count("*").alias("occurrences")).join(vocab.select("unit"), "unit", "left_anti")


def inspect(track: DataFrame) -> DataFrame:
    """label, n, pct of the labelled frames by label, and labelled_pct of all frames; labels that no frame has are left out."""
    n = track.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("label") >= 0, F.col("n")).otherwise(0)).alias("_labelled"))
    return n.where("label >= 0").join(total).select("label", "n", (100 * F.col("n") / F.col("_labelled")).alias("pct"), (100 * F.col("_labelled") / F.col("_all")).alias("labelled_pct"))


def most_common(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value: value, n."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def pair_totals(parts: DataFrame) -> DataFrame:
    """Of parts (pairs, refs, uer): all pairs, all reference tokens, and the rate weighted by these."""
    return parts.agg(F.sum("pairs").alias("pairs"), F.sum("refs").alias("refs"), (F.sum(F.col("uer") * F.col("refs")) / F.greatest(F.sum("refs"), F.lit(1))).alias("uer"))


def by_origin(rows: DataFrame, origins: tuple[str, ...] = ("real", "clean-ref", "clean-text")) -> DataFrame:
    """origin, n: each of the origins, 0 where there is none, and whatever others there are."""
    known = rows.sparkSession.createDataFrame([(o,) for o in origins], "origin string")
    n = rows.groupBy("origin").agg(F.count("*").alias("n"))
    return known.join(n, "origin", "full").select("origin", F.coalesce("n", F.lit(0)).alias("n"))


def shard_summary(utterances: DataFrame, shard: str, seconds: str, size: str, score: str, reason: str) -> DataFrame:
    """One row a shard: utterances kept, hours, megabytes and mean score of these, and a map of how many were skipped for which reason."""
    kept = F.col(reason).isNull()
    own = lambda c: F.when(kept, F.col(c))
    base = utterances.groupBy(shard).agg(F.count_if(kept).alias("utterances"), (F.coalesce(F.sum(own(seconds)), F.lit(0.0)) / 3600).alias("hours"), (F.coalesce(F.sum(own(size)), F.lit(0)) / 1e6).alias("mb"), F.avg(own(score)).alias("mean_score"))
    why = utterances.where(~kept).groupBy(shard, reason).agg(F.count("*").alias("n")).groupBy(shard).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("skipped"))
    return base.join(why, shard, "left").withColumn("skipped", F.coalesce("skipped", F.create_map().cast("map<string,bigint>")))


def unit_report(rows: DataFrame, unit: str, duration: str, score: str, threshold: float, least: int = 20) -> DataFrame:
    """Of units seen `least` times: n, mean and median duration, mean and median score, and the share of scores below the threshold."""
    g = rows.groupBy(unit).agg(F.count("*").alias("n"), F.avg(duration).alias("mean"), F.median(duration).alias("median"), F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), (100 * F.avg((F.col(score) < threshold).cast("int"))).alias("dropped_pct"))
    return g.where(F.col("n") >= least)
