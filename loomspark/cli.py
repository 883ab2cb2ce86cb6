"""Command line: `python -m loomspark.cli COMMAND ...`. Inputs and outputs are paths that Spark reads and writes."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import get_language
from loomspark.operators import decode, runs, sampling, stats
from loomspark.session import build, ship
from loomspark.sources import io


def _texts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """text: lines of text files, or the text column of Parquet tables."""
    if args.table:
        df = spark.read.parquet(*args.inputs)
        column = io.find_column(df, "text", args.text_column)
        if column is None:
            raise SystemExit(f"no text column; there are {df.columns}")
        df = df.limit(args.limit) if args.limit else df
        return df.select(F.col(column).cast("string").alias("text")).where("coalesce(text, '') <> ''")
    lines = reduce(DataFrame.unionByName, [io.read_lines(spark, p) for p in args.inputs])
    return lines.limit(args.limit) if args.limit else lines


def text_to_units(spark: SparkSession, args: argparse.Namespace) -> None:
    lang = get_language(args.language)
    t = _texts(spark, args).select("text", lang.segment(F.col("text")).alias("w"))
    if args.drop_unchanged:
        t = t.where(F.size("w") > 0)
    per_word = F.array_join(F.transform("w", lambda x: F.array_join(x, " ")), " | ")
    units = per_word if args.per_word else F.array_join(F.flatten("w"), " ")
    out = t.select("text", units.alias("units"), F.size(F.flatten("w")).alias("n_units"), F.size("w").alias("n_words"))
    if args.format == "text":
        out = out.withColumn("id", F.xxhash64("text"))
    io.write_records(out, args.output, args.format)


def finetune_data(spark: SparkSession, args: argparse.Namespace) -> None:
    lang = get_language(args.language)
    t = _texts(spark, args).select("text", lang.units(F.col("text")).alias("u"))
    made = t.where(F.size("u") >= args.min_units).select(F.array_join("u", " ").alias("units"), "text", F.lit("synthetic").alias("origin"), F.lit(",".join(args.inputs)).alias("source"), F.xxhash64("text").cast("string").alias("id"), F.lit(None).cast("string").alias("reference_units"))
    real = io.read_table_pairs(spark, args.real, args.real_limit or None) if args.real.endswith(".parquet") else io.read_pairs(spark, args.real)
    if made.isEmpty():
        raise SystemExit("no line gave enough units")
    only = real.where("origin = 'real'")
    real = real if only.isEmpty() else only
    if real.isEmpty():
        raise SystemExit(f"{args.real} has no pairs")
    mixed, report = sampling.mix(made, real, "source", "id", args.ratio, args.balance, args.seed, not args.no_shuffle)
    io.write_pairs(mixed, args.output)
    print(sampling.describe_mix(report), file=sys.stderr)
    if args.report:
        report.withColumn("language", F.lit(lang.code)).coalesce(1).write.mode("overwrite").json(args.report)


def _decoded(spark: SparkSession, rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    """id, units, n_units, confidence, error of rows (utt, samples, error); a row that can't be read is a record with its error."""
    from loomspark.functions.audio import log_mel_udf
    from loomspark.functions.tagger import load, long_posteriors, posteriors_udf

    tagger = load(args.model)
    ship(spark)
    mels = rows.select("utt", log_mel_udf(F.col("samples")).alias("mel"))
    long = long_posteriors(mels.select("utt", posteriors_udf(spark, tagger, F.col("mel")).alias("p")), "p")
    best = decode.argmax(decode.smooth(long, args.smooth))
    got = decode.runs(best, args.min_frames, args.min_confidence, None if args.keep_silence else 0)
    names = F.array(*map(F.lit, tagger.classes))
    got = got.withColumn("unit", F.element_at(names, F.col("class") + 1))
    by_utt = got.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("start", "unit"))).alias("u"), F.round(F.avg("confidence"), 4).alias("confidence"))
    done = rows.select("utt", "error").join(by_utt, "utt", "left")
    return done.select(F.col("utt").alias("id"), F.coalesce(F.array_join(F.transform("u", lambda x: x["unit"]), " "), F.lit("")).alias("units"), F.coalesce(F.size("u"), F.lit(0)).alias("n_units"), "confidence", "error")


def transcribe(spark: SparkSession, args: argparse.Namespace) -> None:
    from loomspark.functions.audio import decode_pcm

    ship(spark)
    files = io.audio_files(spark, args.inputs, not args.no_recursive).withColumn("d", decode_pcm(F.col("content")))
    io.write_records(_decoded(spark, files.select(F.col("path").alias("utt"), "d.samples", "d.error"), args), args.output, args.format)


def table(spark: SparkSession, args: argparse.Namespace) -> None:
    """Transcribe the audio column of Parquet tables; with --score the units are held against the text column."""
    from loomspark.functions.audio import decode_pcm, waveform
    from loomspark.functions.distance import pair_uer

    ship(spark)
    # a row is known by its file and its place there, so every branch of the plan means the same rows
    found = spark.read.parquet(*args.inputs).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    if args.offset or args.limit:
        found = sampling.page(found, ["_file", "_at"], args.offset, args.limit or 2**31 - 1)
    df = found.withColumn("utt", F.concat_ws(":", F.element_at(F.split("_file", "/"), -1), "_at")).drop("_file", "_at")
    audio = io.find_column(df.drop("utt"), "audio", args.audio_column)
    kind = df.schema[audio].dataType
    read = waveform(F.col(audio), kind.names) if hasattr(kind, "names") else decode_pcm(F.col(audio))
    out = _decoded(spark, df.select("utt", read.alias("d")).select("utt", "d.samples", "d.error"), args)
    text = io.find_column(df, "text", args.text_column)
    if args.score and text:
        lang = get_language(args.language)
        ref = df.select(F.col("utt").alias("id"), lang.units(F.col(text)).alias("r"))
        out = out.join(ref, "id").withColumn("uer", pair_uer(F.filter(F.split("units", " "), lambda u: u != ""), F.col("r"))).withColumn("reference_units", F.array_join("r", " ")).drop("r")
        mean = out.where("error is null").agg(F.count("uer").alias("n"), F.avg("uer").alias("uer")).first()
        print(f"{mean.n} rows scored, mean UER {mean.uer or 0:.4f}", file=sys.stderr)
    io.write_records(out, args.output, args.format)


def finetune(spark: SparkSession, args: argparse.Namespace) -> None:
    """What a transfer between two vocabularies (Parquet: class, unit) would keep, add and drop. Training itself is external."""
    for r in stats.vocab_remap(spark.read.parquet(args.old), spark.read.parquet(args.new)).orderBy("status", "unit").toLocalIterator():
        print(r.status, r.unit, r.old_class, r.new_class, sep="\t")


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    """Shares of the labels of a stored track (Parquet: utt, t, label), largest first."""
    for r in stats.inspect(spark.read.parquet(args.track)).orderBy(F.desc("n"), "label").toLocalIterator():
        print(r.label, r.n, f"{r.pct:.2f}", f"{r.labelled_pct:.2f}", sep="\t")


def real_pairs(spark: SparkSession, args: argparse.Namespace) -> None:
    """One published set of all shards' CSV files: Parquet, counts by source on standard error; --sample writes a draw instead."""
    pairs, counts = io.finalise(spark, args.folder)
    for r in counts.orderBy("source").toLocalIterator():
        print(r.source, r.n, sep="\t", file=sys.stderr)
    io.write_pairs_parquet(sampling.sample_published(pairs, "source", "id", args.sample, "id", args.seed) if args.sample else pairs, args.output)


def info(spark: SparkSession | None, args: argparse.Namespace) -> None:
    with open(args.document, encoding="utf-8") as f:
        doc = json.load(f)
    print(json.dumps(doc, ensure_ascii=False, indent=2) if args.json else runs.describe(doc))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomspark")
    sub = top.add_subparsers(dest="command", required=True)

    def texts(p: argparse.ArgumentParser) -> None:
        p.add_argument("inputs", nargs="+")
        p.add_argument("--table", action="store_true", help="inputs are Parquet tables")
        p.add_argument("--text-column")
        p.add_argument("-n", "--limit", type=int, default=0, help="0: all")
        p.add_argument("-l", "--language", default="twi")
        p.add_argument("-o", "--output", required=True)

    def decoding(p: argparse.ArgumentParser) -> None:
        p.add_argument("--model", required=True, help="weights as tagger.save() writes them (npz)")
        p.add_argument("--smooth", type=int, default=7)
        p.add_argument("--min-frames", type=int, default=2)
        p.add_argument("--min-confidence", type=float, default=0.0)
        p.add_argument("--keep-silence", action="store_true")

    formats = {"choices": ("jsonl", "json", "csv", "text"), "default": "jsonl"}
    p = sub.add_parser("text-to-units")
    texts(p)
    p.add_argument("-f", "--format", **formats)
    p.add_argument("--per-word", action="store_true")
    p.add_argument("--drop-unchanged", action="store_true")
    p.set_defaults(run=text_to_units)
    p = sub.add_parser("finetune-data")
    texts(p)
    p.add_argument("--real", required=True)
    p.add_argument("--real-limit", type=int, default=0)
    p.add_argument("--balance", choices=("proportional", "equal"), default="proportional")
    p.add_argument("--ratio", type=float, default=1.0)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--no-shuffle", action="store_true")
    p.add_argument("--min-units", type=int, default=5)
    p.add_argument("--report")
    p.set_defaults(run=finetune_data)
    p = sub.add_parser("transcribe")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--format", **formats)
    p.add_argument("--no-recursive", action="store_true")
    decoding(p)
    p.set_defaults(run=transcribe)
    p = sub.add_parser("table")
    texts(p)
    p.add_argument("-f", "--format", **formats)
    p.add_argument("--audio-column")
    p.add_argument("--offset", type=int, default=0, help="rows to skip; the limit counts those after them")
    p.add_argument("--score", action="store_true")
    decoding(p)
    p.set_defaults(run=table)
    p = sub.add_parser("finetune")
    p.add_argument("old")
    p.add_argument("new")
    p.set_defaults(run=finetune)
    p = sub.add_parser("inspect")
    p.add_argument("track")
    p.set_defaults(run=inspect)
    p = sub.add_parser("real-pairs")
    p.add_argument("folder")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--sample", type=int, default=0)
    p.add_argument("--seed", type=int, default=0)
    p.set_defaults(run=real_pairs)
    p = sub.add_parser("info")
    p.add_argument("document")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=info)
    return top


def main(argv: list[str] | None = None) -> int:
    """Unknown commands and options exit with 2."""
    args = parser().parse_args(argv)
    args.run(None if args.command == "info" else build("loomspark-cli"), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
