"""From per-frame posteriors to unit sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smooth(long: DataFrame, width: int, utt: str = "utt") -> DataFrame:
    """long (utt, t, class, p): centred moving average with replicated edges; an even width looks further back than ahead."""
    if width <= 1:
        return long
    back, ahead = width // 2, width - 1 - width // 2
    part = Window.partitionBy(utt, "class").orderBy("t")
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(part) - 1, F.count("*").over(whole)
    left, right = F.greatest(F.lit(back) - i, F.lit(0)), F.greatest(i + ahead - (n - 1), F.lit(0))
    total = F.sum("p").over(part.rowsBetween(-back, ahead)) + left * F.first("p").over(whole) + right * F.last("p").over(whole)
    return long.withColumn("p", total / width)


def argmax(long: DataFrame, utt: str = "utt") -> DataFrame:
    """(utt, t, class, p): the best class of each frame, the least of equals."""
    best = long.groupBy(utt, "t").agg(F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("b"))
    return best.select(utt, "t", (-F.col("b.c")).alias("class"), F.col("b.p").alias("p"))


def runs(best: DataFrame, min_frames: int = 1, min_confidence: float = 0.0, drop_class: int | None = None, utt: str = "utt") -> DataFrame:
    """(utt, class, start, n, confidence) of the maximal runs of one class that pass the gates."""
    w = Window.partitionBy(utt).orderBy("t")
    new = F.coalesce((F.lag("class").over(w) != F.col("class")).cast("int"), F.lit(1))
    marked = best.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = marked.groupBy(utt, "_run").agg(F.first("class").alias("class"), F.min("t").alias("start"), F.count("*").alias("n"), F.avg("p").alias("confidence"))
    gate = (F.col("n") >= min_frames) & (F.col("confidence") >= min_confidence)
    return got.where(gate if drop_class is None else gate & (F.col("class") != drop_class)).drop("_run")


def split_long(run: DataFrame, medians: DataFrame, frame_s: float = 0.01, most: int = 3) -> DataFrame:
    """Runs as units with times in seconds; one of about k median lengths becomes k units (half-even, 1 to `most`)."""
    j = run.join(medians, "class", "left")
    reps = F.when(F.coalesce("median_frames", F.lit(0.0)) > 0, F.greatest(F.lit(1), F.least(F.lit(most), F.bround(F.col("n") / F.col("median_frames")).cast("int")))).otherwise(1)
    each = j.withColumn("reps", reps).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)))
    at = lambda k: (F.col("start") + F.col("n") * k / F.col("reps")) * frame_s
    return each.withColumn("start_s", at(F.col("r"))).withColumn("end_s", at(F.col("r") + 1)).drop("median_frames")


def collapse(seq: Column, silence: int = 0) -> Column:
    """Neighbours that are equal become one; silence and negatives break runs and go."""
    ends = F.filter(seq, lambda x, i: (i == 0) | (x != F.element_at(seq, F.greatest(i, F.lit(1)))))
    return F.filter(ends, lambda x: (x != silence) & (x >= 0))


def early_stop(history: DataFrame, order: str, metric: str, delta: float, patience: int, higher: bool = True) -> DataFrame:
    """best, stop (index at which patience ran out, or null): the running best with a margin is order-dependent, so it folds over the ordered history (a row for each epoch)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(metric).cast("double").alias("m")))), lambda r: r["m"])
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("stale"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("stop"))

    def step(s, m):
        better = s["best"].isNull() | ((m > s["best"] + delta) if higher else (m < s["best"] - delta))
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        new = F.struct(F.when(better, m).otherwise(s["best"]).alias("best"), stale.alias("stale"), (s["i"] + 1).alias("i"), F.when(stale >= patience, s["i"]).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    return history.agg(F.aggregate(rows, zero, step).alias("s")).select("s.best", "s.stop")
