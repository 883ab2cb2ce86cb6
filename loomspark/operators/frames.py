"""Dense label tracks from aligned spans, and overlapping chunks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE, SILENCE = -100, 0


def paint(spans: DataFrame, utt: str = "utt") -> DataFrame:
    """spans (utt, k, label, start, end) to (utt, t, label): an interval join as exploded frames; of overlapping spans the last one (k) wins."""
    long = spans.where("end > start").select(utt, "k", "label", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"))
    return long.groupBy(utt, "t").agg(F.max_by("label", "k").alias("label"))


def classify(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """Left join on the unit with class -100 where the vocabulary has none."""
    return units.join(vocab.select("unit", "class"), "unit", "left").withColumn("label", F.coalesce("class", F.lit(IGNORE)))


def gap_runs(frames: DataFrame, utt: str = "utt") -> DataFrame:
    """frames (utt, t, covered) to gaps (utt, start, end), half-open, of neighbouring frames that are not covered."""
    w = Window.partitionBy(utt).orderBy("t")
    run = frames.where("not covered").withColumn("g", F.col("t") - F.row_number().over(w))
    return run.groupBy(utt, "g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("g")


def label_track(frames: DataFrame, painted: DataFrame, min_gap: int, percentile: float = 10.0, least_covered: int = 20, gaps_ignored: bool = False, utt: str = "utt") -> DataFrame:
    """frames (utt, t, energy), painted (utt, t, label) to (utt, t, label, kind).

    An uncovered frame is silence if its gap is long enough and its energy is strictly below the percentile of the
    utterance's covered energies; kinds: unit, silence, short_gap, loud_gap."""
    w = Window.partitionBy(utt).orderBy("t")
    base = frames.join(painted, [utt, "t"], "left").withColumn("covered", F.col("label").isNotNull())
    stats = base.where("covered").groupBy(utt).agg(F.percentile("energy", F.lit(percentile / 100)).alias("floor"), F.count("*").alias("n_covered"))
    isle = base.withColumn("g", F.when(~F.col("covered"), F.sum(F.col("covered").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    sized = isle.withColumn("gap", F.count("*").over(Window.partitionBy(utt, "g")))
    j = sized.join(stats, utt, "left")
    quiet = F.lit(percentile >= 100) | (F.coalesce("n_covered", F.lit(0)) < least_covered) | (F.col("energy") < F.col("floor"))
    kind = F.when(F.col("covered"), "unit").when(F.col("gap") < min_gap, "short_gap").when(F.lit(gaps_ignored), "short_gap").when(F.coalesce(quiet, F.lit(True)), "silence").otherwise("loud_gap")
    return j.withColumn("kind", kind).select(utt, "t", F.when(F.col("covered"), F.col("label")).when(F.col("kind") == "silence", SILENCE).otherwise(IGNORE).alias("label"), "kind")


def track_stats(track: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return track.agg(n("silence"), n("short_gap"), n("loud_gap"), F.count_if(F.col("label") >= 0).alias("labelled"), F.count("*").alias("frames"))


def chunks(utterances: DataFrame, size: int, stride: int, utt: str = "utt", n: str = "n_frames") -> DataFrame:
    """(utt, start, valid_len): starts by stride and a tail pulled back to the end; a short utterance is one chunk."""
    last = F.col(n) - size
    starts = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")), F.array(last.cast("long"))))
    return utterances.where(F.col(n) > 0).select(utt, F.explode(starts).alias("start"), F.least(F.col(n).cast("long"), F.lit(size).cast("long")).alias("valid_len"))


def chunk_label_counts(chunk: DataFrame, track: DataFrame, utt: str = "utt") -> DataFrame:
    """label, n over chunk frames; a frame counts once for each chunk that holds it. The range join is exploded to an equi-join on frames."""
    at = chunk.select(utt, F.explode(F.sequence("start", F.col("start") + F.col("valid_len") - 1)).alias("t")).groupBy(utt, "t").agg(F.count("*").alias("times"))
    return track.where("label >= 0").join(at, [utt, "t"]).groupBy("label").agg(F.sum("times").alias("n"))


def offsets(utterances: DataFrame, shard: str, order: str, n: str, ranges: int = 64) -> DataFrame:
    """Where each utterance begins in its shard's blob, in the order of a numeric column: equal ranges of it are summed within themselves and
    then among each other, so that a large shard is as many tasks as it has ranges."""
    lo, hi = utterances.agg(F.min(order), F.max(order)).first()
    width = max((float(hi) - float(lo)) / ranges, 1e-12) if lo is not None else 1.0
    b = utterances.withColumn("_b", F.coalesce(F.least(F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)), F.lit(ranges - 1)).cast("int"), F.lit(-1)))
    w = Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = b.groupBy(F.col(shard).alias("_s"), F.col("_b").alias("_at")).agg(F.sum(n).alias("_n")).select("_s", F.col("_at"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    within = Window.partitionBy(shard, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    j = b.withColumn("_off", F.coalesce(F.sum(n).over(within), F.lit(0))).join(before, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_at")))
    return j.select(*utterances.columns, (F.col("_base") + F.col("_off")).alias("off"))


def padded(chunk: DataFrame, track: DataFrame, size: int, utt: str = "utt") -> DataFrame:
    """Chunks with their labels as arrays of `size`, padded with IGNORE."""
    at = chunk.select(utt, "start", F.explode(F.sequence("start", F.col("start") + F.col("valid_len") - 1)).alias("t")).join(track, [utt, "t"])
    got = at.groupBy(utt, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda x: x["label"]).alias("labels"))
    return got.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORE), F.lit(size) - F.size("labels"))))


def above_floor(utterances: DataFrame, score: str, least: float) -> DataFrame:
    """Utterances whose score reaches the floor; of the others there are no frames and no chunks. A null score doesn't reach it."""
    return utterances.where(F.col(score) >= least)


def floored(track: DataFrame, utterances: DataFrame, score: str, least: float, utt: str = "utt") -> DataFrame:
    """The track with every frame of an utterance below the floor ignored, as kind low_score."""
    good = above_floor(utterances, score, least).select(utt).distinct().withColumn("_good", F.lit(True))
    j = track.join(good, utt, "left")
    return j.select(utt, "t", F.when(F.col("_good"), F.col("label")).otherwise(IGNORE).alias("label"), F.when(F.col("_good"), F.col("kind")).otherwise("low_score").alias("kind"))


def track_counters(track: DataFrame, chunk: DataFrame, utt: str = "utt") -> DataFrame:
    """One row: what track_stats() counts over utterances that reach the floor, their number, those below it, and chunks."""
    own = F.col("kind") != "low_score"
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counted = track.agg(n("silence"), n("short_gap"), n("loud_gap"), F.count_if(own & (F.col("label") >= 0)).alias("labelled"), F.count_if(own).alias("frames"), F.count_distinct(F.when(own, F.col(utt))).alias("utts"), F.count_distinct(F.when(~own, F.col(utt))).alias("low_score_utts"))
    return counted.join(chunk.agg(F.count("*").alias("chunks")))


def class_counts(chunk: DataFrame, track: DataFrame, vocab: DataFrame) -> DataFrame:
    """class, n for every class of the vocabulary: 0 where no chunk frame has it."""
    n = chunk_label_counts(chunk, track).select(F.col("label").alias("class"), "n")
    return vocab.select("class").join(n, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def zip_by_position(left: DataFrame, right: DataFrame, shard: str, at: str) -> DataFrame:
    """Rows of two tables that have the same place in the same shard; a place that only one of them has is an error."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    j = a.join(b, [shard, at], "full")
    wrong = F.raise_error(F.concat(F.lit("row "), F.col(at).cast("string"), F.lit(" of shard "), F.col(shard).cast("string"), F.lit(" is in one table only"))).cast("boolean")
    return j.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), wrong).otherwise(True)).drop("_l", "_r")


def clamp_span(start_s: Column, end_s: Column, n_frames: Column, frames_per_s: int = 100) -> Column:
    """struct<start, end> in frames: seconds rounded half-even; start within 0..n-1, end within start+1..n, so that spans may overlap by a frame."""
    at = lambda x: F.bround(x * frames_per_s).cast("long")
    s = F.greatest(F.lit(0).cast("long"), F.least(at(start_s), n_frames - 1))
    return F.struct(s.alias("start"), F.greatest(s + 1, F.least(at(end_s), n_frames)).alias("end"))


def token_spans(tokens: DataFrame, frame_s: float, wildcard: str = "<star>") -> DataFrame:
    """tokens (token, first, last, scores) without wildcards: start and end in seconds, and the mean score of the frames between (0 for none)."""
    size = F.col("last") - F.col("first")
    total = F.aggregate(F.slice("scores", F.col("first") + 1, F.greatest(size, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return tokens.where(F.col("token") != wildcard).withColumns({"start_s": F.col("first") * frame_s, "end_s": F.col("last") * frame_s, "score": F.when(size > 0, total / size).otherwise(F.lit(0.0))}).drop("scores")


def tiles(utterances: DataFrame, size: int, margin: int, utt: str = "utt", n: str = "n_frames") -> DataFrame:
    """(utt, from, to, keep_from, keep_to): stretches that are computed with margins on both sides, and what of each is kept. The kept parts cover
    every frame once; with margins as wide as the context is, tiles give what one pass gives."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(size).cast("long")))
    t = utterances.where(F.col(n) > 0).select(utt, F.col(n).cast("long").alias("_n"), begin.alias("keep_from"))
    end = F.least(F.col("keep_from") + size, F.col("_n"))
    return t.select(utt, F.greatest(F.col("keep_from") - margin, F.lit(0)).alias("from"), F.least(end + margin, F.col("_n")).alias("to"), "keep_from", end.alias("keep_to"))


def time_mask(key: Column, n: Column, most: int, seed: int = 0) -> Column:
    """struct<start, end>: a random stretch of up to `most` of n frames, by a hash of the key."""
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    size = F.least(F.pmod(u(0), F.lit(most + 1)), n)
    start = F.pmod(u(1), n - size + 1)
    return F.struct(start.alias("start"), (start + size).alias("end"))


def masked(values: Column, mask: Column, fill: Column) -> Column:
    """An array with fill inside the mask: IGNORE for labels, the mean for features."""
    return F.transform(values, lambda x, i: F.when((i >= mask["start"]) & (i < mask["end"]), fill).otherwise(x))


def ms_to_frames(ms: Column, frame_ms: int = 10, least: int = 0) -> Column:
    """Whole frames of a length in milliseconds; a stride is one at least."""
    return F.greatest(F.floor(ms / frame_ms).cast("long"), F.lit(least).cast("long"))


def chunk_features(chunk: DataFrame, frame: DataFrame, value: str, size: int, mean: float = 0.0, std: float = 1.0, utt: str = "utt") -> DataFrame:
    """Chunks with their normalised features and labels as arrays of `size`, padded with 0 and IGNORE. frame: utt, t, value, label."""
    at = chunk.select(utt, "start", F.explode(F.sequence("start", F.col("start") + F.col("valid_len") - 1)).alias("t")).join(frame, [utt, "t"])
    rows = F.array_sort(F.collect_list(F.struct("t", ((F.col(value) - mean) / std).alias("x"), "label")))
    got = at.groupBy(utt, "start").agg(rows.alias("r"))
    fill = lambda k, v: F.concat(F.transform("r", lambda x: x[k]), F.array_repeat(F.lit(v), F.lit(size) - F.size("r")))
    return got.select(utt, "start", fill("x", 0.0).alias("features"), fill("label", IGNORE).alias("labels"))
