"""Pairs of units and text: gates, sources, training layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.distance import pair_uer

# Append-only ids of the sources, and those with human transcripts.
SOURCE_IDS = {"tts": 1, "asr": 2, "kuma": 3, "female": 4, "agric": 5, "multispk": 6, "bible": 7}
HUMAN_IDS = (1, 4, 5, 7)
# Limits of an utterance.
MIN_DURATION_S, MAX_DURATION_S, MIN_UNITS, MIN_UNITS_PER_SEC, MAX_UNITS_PER_SEC = 0.4, 31.0, 3, 3.0, 32.0

PROMPT, MARKER, IGNORE = "Units: {units}\nTwi text:", "Twi text:", -100


def utterance_gate(text: Column, seconds: Column, n_units: Column) -> Column:
    """The first reason to skip an utterance, or null."""
    rate = n_units / seconds
    return (
        F.when(text.isNull() | (F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == ""), "empty_text")
        .when(seconds.isNull(), "decode_error")
        .when((seconds < MIN_DURATION_S) | (seconds > MAX_DURATION_S), "duration")
        .when(n_units < MIN_UNITS, "few_units")
        .when((rate < MIN_UNITS_PER_SEC) | (rate > MAX_UNITS_PER_SEC), "rate")
    )


def pair_gate(source: Column, text: Column, uer: Column, excluded: list, min_chars: int, max_uer: float) -> Column:
    """The first reason to drop a pair, or null; the rate is tested only where there is one and the limit is below 1."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    out = F.when(source.isin(excluded), "source").when(F.char_length(trimmed) < min_chars, "short")
    return out.when(uer > max_uer, "uer") if max_uer < 1 else out


def maker_gate(text: Column, score: Column, n_ref: Column, uer: Column, min_score: float, min_ref: int, max_uer: float) -> Column:
    """The first reason not to make a pair of an utterance and its transcription, or null."""
    blank = text.isNull() | (F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == "")
    return F.when(blank, "no_text").when(score < min_score, "low_score").when(n_ref < min_ref, "short_reference").when(uer > max_uer, "uer")


def defaults(rows: DataFrame, order: str, offset: int = 0) -> DataFrame:
    """Pairs with all six columns: origin real, source empty, id the row's place from `offset` on where there is none. Rows without units or text go.

    Places follow from a sort in ranges and the ranges' sizes: no task numbers the whole table."""
    for c in ("origin", "source", "id", "reference_units"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    some = lambda c, v: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), v).alias(c)
    placed = numbered(rows, order)
    kept = placed.where("coalesce(units, '') <> '' and coalesce(text, '') <> ''")
    return kept.select("units", "text", some("origin", F.lit("real")), some("source", F.lit("")), some("id", (F.col("place") + offset).cast("string")), "reference_units")


def numbered(rows: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """rows with place (from 0) by a numeric column: equal ranges between its least and greatest value are sorted, and their sizes added up. Nulls come first."""
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    width = max((float(hi) - float(lo)) / ranges, 1e-12) if lo is not None else 1.0
    b = rows.withColumn("_b", F.coalesce(F.least(F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)), F.lit(ranges - 1)).cast("int"), F.lit(-1)))
    before = b.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    r = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).join(before, "_b")
    return r.withColumn("place", F.col("_r") + F.col("_base")).drop("_b", "_r", "_base")


def replace_split(rows: DataFrame, other: DataFrame, split: str = "test") -> DataFrame:
    """rows with a split's rows replaced by those of another table, whose missing source and target texts are units and text."""
    for c, of in (("source_text", "units"), ("target_text", "text")):
        if c not in other.columns:
            other = other.withColumn(c, F.col(of))
    return rows.where(F.col("split") != split).unionByName(other.withColumn("split", F.lit(split)), allowMissingColumns=True)


def with_uer(pairs: DataFrame) -> DataFrame:
    """pairs (units, reference_units, space-separated) with uer; null without a reference."""
    tokens = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    return pairs.withColumn("uer", F.when(F.col("reference_units").isNotNull(), pair_uer(tokens(F.col("units")), tokens(F.col("reference_units")))))


def keep_real_or_all(pairs: DataFrame) -> DataFrame:
    """Real pairs, or all where there is none."""
    some = pairs.where("origin = 'real'").limit(1).agg((F.count("*") > 0).alias("_some"))
    return pairs.join(F.broadcast(some)).where("origin = 'real' or not _some").drop("_some")


def source_text(units: Column, spaced: bool) -> Column:
    return units if spaced else F.replace(units, F.lit(" "), F.lit(""))


def with_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    raw = F.coalesce("raw_source", "source_text") if "raw_source" in rows.columns else F.col("source_text")
    return rows.withColumn("raw_source", raw).withColumn("source_text", F.concat(F.lit(prefix), raw))


def source_id(names: DataFrame, split: str) -> DataFrame:
    """Numeric id of each split; an unknown one fails and names the next free id."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_IDS.items() for x in kv])
    message = F.concat(F.lit("no source id for "), F.col(split), F.lit(f"; next free id is {max(SOURCE_IDS.values()) + 1}"))
    return names.withColumn("source_id", F.coalesce(table[F.col(split)], F.raise_error(message).cast("int")))


def strip_prompt(decoded: Column) -> Column:
    return F.regexp_replace(F.substring_index(decoded, MARKER, -1), r"(?U)^\s+|\s+$", "")


def build_example(source: Column, target: Column, prompt: Column, suffix: Column, most: int, eos: int) -> Column:
    """struct<input_ids, labels> of token arrays: the source is cut first, then wrapped; the prompt is ignored in the labels, the target ends in eos."""
    head = F.concat(prompt, F.slice(source, 1, most), suffix)
    tail = F.concat(target, F.array(F.lit(eos)))
    return F.struct(F.concat(head, tail).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(head)), tail).alias("labels"))


def collate(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Examples padded to the longest of their batch."""
    size = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_m"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_m") - F.size(c)))
    out = rows.join(size, batch).withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("_m") - F.size("input_ids"))))
    return out.withColumn("input_ids", fill("input_ids", pad)).withColumn("labels", fill("labels", IGNORE)).drop("_m")
