"""What a training run leaves behind: context probes, text scores, schedules, provenance and model cards."""

from __future__ import annotations

import json
import math
import platform
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import audio
from loomspark.functions.distance import cer, wer


MOST_PATTERNS = 1000


def probe_report(hits: DataFrame, least: int = 20) -> DataFrame:
    """Of (class, margin, hit): accuracy by margin over all classes (class null), and by margin and class for classes seen `least` times.

    Margin null, the whole utterance, is written as -1. One aggregation in grouping sets."""
    h = hits.select("class", F.coalesce("margin", F.lit(-1)).alias("margin"), F.col("hit").cast("int").alias("hit"))
    g = h.groupingSets([["margin"], ["margin", "class"]], "margin", "class").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.grouping("class").alias("_all"))
    return g.where((F.col("_all") == 1) | (F.col("n") >= least)).select("margin", "class", "n", "accuracy")


def probe_contrasts(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, margin, n, accuracy over both classes of each pair."""
    h = hits.select("class", F.coalesce("margin", F.lit(-1)).alias("margin"), F.col("hit").cast("int").alias("hit"))
    j = h.join(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("class")), "class")
    return j.groupBy("a", "b", "margin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def text_scores(rows: DataFrame, hyp: str, ref: str, source: str | None = None) -> DataFrame:
    """One row: mean CER and WER, share of exact matches, CER of doing nothing (source against ref), micro and greatest length ratio."""
    h, r = F.coalesce(F.col(hyp), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
    nothing = cer(F.coalesce(F.col(source), F.lit("")), r) if source else F.lit(None).cast("double")
    n_h, n_r = F.length(h), F.length(r)
    each = rows.select(cer(h, r).alias("c"), wer(h, r).alias("w"), (F.trim(h) == F.trim(r)).cast("int").alias("x"), nothing.alias("s"), n_h.alias("h"), n_r.alias("r"))
    return each.agg(
        F.count("*").alias("n"), F.avg("c").alias("cer"), F.avg("w").alias("wer"), F.avg("x").alias("exact"), F.avg("s").alias("baseline_cer"),
        (F.sum("h") / F.greatest(F.sum("r"), F.lit(1))).alias("length_ratio"), F.max(F.col("h") / F.greatest("r", F.lit(1))).alias("max_length_ratio"),
    )


def learning_rate(step: Column, total: int, warmup: int) -> Column:
    """Factor of the base rate: a line up to 1 over the first steps, then half a cosine to 0."""
    rest = (step - warmup) / F.lit(max(1, total - warmup))
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), rest))))


def running_mean(steps: DataFrame, group: str, n: str, *values: str) -> DataFrame:
    """Means of values weighted by n, by group."""
    return steps.groupBy(group).agg(F.sum(n).alias(n), *[(F.sum(F.col(v) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias(v) for v in values])


def artifacts(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """artifact, files, bytes, found: what of the expected path patterns (SQL LIKE, MOST_PATTERNS at most) a listing holds."""
    if (n := expected.count()) > MOST_PATTERNS:
        raise ValueError(f"{n} patterns; every path is held against each, so there may be {MOST_PATTERNS}")
    held = listing.join(F.broadcast(expected), F.expr("path LIKE pattern")).groupBy("artifact").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return expected.select("artifact").join(held, "artifact", "left").na.fill(0, ["files", "bytes"]).withColumn("found", F.col("files") > 0)


def best(rows: DataFrame, metric: str, ties: str, n: int = 1, higher: bool = False) -> DataFrame:
    """The n best rows by a metric (least first, unless higher is better), ties by another column; rows without one don't count."""
    return rows.where(F.col(metric).isNotNull()).orderBy(F.desc(metric) if higher else F.asc(metric), ties).limit(n)


def grid_means(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """n and mean values of each setting of a decode grid."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def key_diff(a: Column, b: Column, first: int = 3) -> Column:
    """struct<missing, unexpected>: the first keys, in order, that only a or only b has."""
    only = lambda x, y: F.slice(F.array_sort(F.array_except(x, y)), 1, first)
    return F.struct(only(a, b).alias("missing"), only(b, a).alias("unexpected"))


def without(entries: Column, keys: list[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(entries, lambda k, _: ~k.isin(keys))


def unprefixed(entries: Column, prefix: str) -> Column:
    """Of a map the entries whose key has the prefix, without it."""
    return F.transform_keys(F.map_filter(entries, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def releasable(best_doc: dict[str, Any], last: dict[str, Any], drop: tuple[str, ...] = ("optimizer", "scheduler", "scaler", "best", "stale")) -> dict[str, Any]:
    """The best checkpoint's description with the last one's weights: what serves to resume goes, the last epoch's metrics come from its history.

    Weights of another shape or with other names are an error that names the first three."""
    mine, other = best_doc["weights"], last["weights"]
    if wrong := sorted(set(mine) ^ set(other))[:3] or sorted(k for k in mine if getattr(mine[k], "shape", None) != getattr(other[k], "shape", None))[:3]:
        raise ValueError(f"the checkpoints differ in {', '.join(wrong)}")
    row = next((r for r in last.get("history", []) if r.get("epoch") == last.get("epoch")), {})
    metrics = {k.removeprefix("val_"): v for k, v in row.items() if k.startswith("val_")}
    return {k: v for k, v in best_doc.items() if k not in drop} | {"weights": other, "epoch": last.get("epoch")} | ({"val": metrics} if metrics else {})


def provenance(corpus: DataFrame, split: str, sources: dict[str, Any], labels: dict[str, Any], training: dict[str, Any], language: str, commit: str | None = None, extra: dict[str, Any] | None = None) -> dict[str, Any]:
    """An audit document: who made what from which data. corpus has one row for each split (stats.corpus_summary)."""
    rows = [r.asDict(recursive=True) for r in corpus.collect()]
    return {
        "created_utc": datetime.now(UTC).isoformat(timespec="seconds"), "language": language, "git_commit": commit, "python": platform.python_version(),
        "sources": {r[split]: sources.get(r[split], {"dataset": "unknown"}) for r in rows},
        "corpus": {r[split]: {k: v for k, v in r.items() if k != split} for r in rows},
        "label_policy": labels, "training": training,
        "features": {"sample_rate": audio.RATE, "n_fft": audio.N_FFT, "hop_length": audio.HOP, "n_mels": audio.N_MELS, "f_min": audio.F_MIN, "f_max": audio.F_MAX, "frame_ms": 1000 * audio.HOP // audio.RATE},
    } | (extra or {})


def describe(doc: dict[str, Any]) -> str:
    """The document on one screen; what is missing is a question mark."""
    p = doc.get("provenance") or doc
    lines = [f"{name:<12} {p.get(key) or '?'}" for name, key in (("language", "language"), ("created", "created_utc"), ("commit", "git_commit"))]
    lines += [f"{name:<12} {doc.get(key, '?')}" for name, key in (("classes", "n_classes"), ("context ms", "receptive_field_ms")) if key in doc]
    for name, key in (("training", "training"), ("validation", "val")):
        if found := p.get(key) or doc.get(key):
            lines.append(f"{name:<12} " + "  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in found.items()))
    for split, c in sorted((p.get("corpus") or {}).items()):
        lines.append(f"  {split:<10} " + "  ".join(f"{k}={v}" for k, v in c.items()))
    return "\n".join(lines)


def model_card(doc: dict[str, Any], title: str) -> str:
    """Markdown: the description, then the whole document."""
    return f"# {title}\n\n```\n{describe(doc)}\n```\n\n```json\n{json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True, default=str)}\n```\n"
