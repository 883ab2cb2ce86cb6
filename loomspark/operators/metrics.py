"""Confusion counts, per-class reports, corpus rates, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    return pairs.groupBy(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """class, support, predicted, hits, precision, recall, f1; 0 where a denominator is 0. One pass: each cell counts for its row and its column."""
    cell = F.explode(F.array(F.struct(F.col("ref").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")
    t = conf.select(cell).groupBy(F.col("x.class").alias("class")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    return t.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "support"), "f1": f1})


def summary(report: DataFrame) -> DataFrame:
    """accuracy; balanced accuracy and macro F1 over the classes that occur."""
    seen = F.col("support") > 0
    return report.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"))


def contrasts(conf: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a, b): recalls, cross-confusions and supports; null without support."""
    j = conf.join(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("ref")), "ref")
    n = lambda r, p: F.sum(F.when((F.col("ref") == F.col(r)) & (F.col("pred") == F.col(p)), F.col("n")).otherwise(0))
    s = lambda r: F.sum(F.when(F.col("ref") == F.col(r), F.col("n")).otherwise(0))
    g = j.groupBy("a", "b").agg(s("a").alias("support_a"), s("b").alias("support_b"), n("a", "a").alias("aa"), n("a", "b").alias("ab"), n("b", "b").alias("bb"), n("b", "a").alias("ba"))
    r = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return g.select("a", "b", "support_a", "support_b", r("aa", "support_a").alias("recall_a"), r("bb", "support_b").alias("recall_b"), r("ab", "support_a").alias("a_as_b"), r("ba", "support_b").alias("b_as_a"))


def corpus_rates(scored: DataFrame, edits: str = "edits", ref: str = "ref_len", hyp: str = "hyp_len") -> DataFrame:
    """Micro rate (sums over sums), macro rate (mean of rates; an empty reference counts 1), length ratio."""
    rate = F.when(F.col(ref) == 0, F.lit(1.0)).otherwise(F.col(edits) / F.col(ref))
    total = F.greatest(F.sum(ref), F.lit(1))
    return scored.agg(F.count("*").alias("pairs"), (F.sum(edits) / total).alias("micro"), F.avg(rate).alias("macro"), (F.sum(hyp) / total).alias("length_ratio"))


def class_weights(counts: DataFrame, alpha: float) -> DataFrame:
    """w = (sum / count)^alpha over its mean; counts floored at 1. counts has a row for each class."""
    every = Window.partitionBy(F.lit(1))
    c = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = counts.withColumn("_w", F.pow(F.sum(c).over(every) / c, F.lit(alpha)))
    return raw.withColumn("weight", F.col("_w") / F.avg("_w").over(every)).drop("_w")
