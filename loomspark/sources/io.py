"""Readers and writers of pairs, texts, shards and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("units", "text", "origin", "source", "id", "reference_units")])
# Column names that are tried in this order.
AUDIO_HINTS = ("audio", "wav", "speech", "input_audio", "audio_file", "file", "path")
TEXT_HINTS = ("text", "transcription", "transcript", "sentence", "twi_text", "normalized_text")


def _filled(df: DataFrame) -> DataFrame:
    some = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    return df.select("units", "text", some("origin", "real"), some("source", ""), some("id", ""), "reference_units")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (units and text are required; bad rows fail) or CSV (rows without units or text go; ids default to the row's number, from 2)."""
    if path.endswith((".csv", ".csv.gz")):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        if missing := {"units", "text"} - set(raw.columns):
            raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
        for c in PAIR.names:
            if c not in raw.columns:
                raw = raw.withColumn(c, F.lit(None).cast("string"))
        # a column of its own: what numbers rows must see all of them, also those that have an id
        named = raw.withColumn("_line", _line(raw)).withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), (F.col("_line") + 2).cast("string")))
        return _filled(named.where("coalesce(units, '') <> '' and coalesce(text, '') <> ''")).withColumn("reference_units", F.nullif(F.col("reference_units"), F.lit("")))
    lines = spark.read.schema(T.StructType([*PAIR.fields, T.StructField("_bad", T.StringType())])).json(path, columnNameOfCorruptRecord="_bad")
    why = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("bad JSON: "), F.col("_bad"))).when(F.col("units").isNull() | F.col("text").isNull(), F.lit("a pair without units or text"))
    checked = lines.withColumn("units", F.when(why.isNotNull(), F.raise_error(F.concat(F.input_file_name(), F.lit(": "), why)).cast("string")).otherwise(F.col("units")))
    return _filled(checked)


def _line(df: DataFrame) -> Column:
    """The place of each row of a scan, from 0: partitions are counted first, so nothing is sorted and no task numbers the whole table."""
    at = F.monotonically_increasing_id()
    counts = df.select(F.shiftright(at, 33).alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()
    before, total = {}, 0
    for r in counts:
        before[r.p] = total
        total += r.n
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.shiftright(at, 33)] if before else F.lit(0)
    return base + at.bitwiseAND(F.lit((1 << 33) - 1))


def read_table_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parquet pairs: the limit comes before the filter on empty rows."""
    df = spark.read.parquet(path)
    df = df.limit(limit) if limit is not None else df
    return df.where("coalesce(units, '') <> '' and coalesce(text, '') <> ''")


def resolve_pairs(spark: SparkSession, ref: str | None, language: str, hub: str | None = None, published: dict[str, str] | None = None, limit: int | None = None) -> tuple[DataFrame, str]:
    """Pairs and where they come from. ref is a file (or folder), or a name with a slash below `hub`; without one, the language's published name. What can't be found is an error."""
    name = ref or (published or {}).get(language)
    if name is None:
        raise ValueError(f"there are no published pairs for {language!r}; name a file or a set")
    for path, what in ((name, "file"), (f"{hub.rstrip('/')}/{name}" if hub and "/" in name else None, "set")):
        if path and _exists(spark, path):
            pairs = read_pairs(spark, path) if path.endswith((".csv", ".csv.gz", ".json", ".jsonl", ".jsonl.gz")) else _filled_columns(read_table_pairs(spark, path, limit))
            return pairs, f"{what} {name}"
    raise FileNotFoundError(f"{name}: neither a file nor a set{f' below {hub}' if hub else ''}")


def _filled_columns(df: DataFrame) -> DataFrame:
    for c in PAIR.names:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return _filled(df)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def resolve_checkpoint(spark: SparkSession, path: str | None, language: str, default: dict[str, str] | None = None, name: str = "best.npz") -> str:
    """A checkpoint's file: the one named, `name` in the folder named, or the language's default; an error that says what was tried."""
    given = path or (default or {}).get(language)
    if given is None:
        raise ValueError(f"no checkpoint was named, and there is no default for {language!r}")
    for found in ([given] if given.endswith(".npz") else [f"{given.rstrip('/')}/{name}"]):
        if _exists(spark, found):
            return found
    raise FileNotFoundError(f"no checkpoint at {given}")


def audio_files(spark: SparkSession, inputs: list[str], recursive: bool = True, extensions: tuple[str, ...] = ("wav", "flac", "mp3", "ogg", "m4a")) -> DataFrame:
    """path, length, content of the audio files in folders (or named), by path. What doesn't exist is an error."""
    if missing := [p for p in inputs if not _exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))
    glob = "*.{" + ",".join([*extensions, *map(str.upper, extensions)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(inputs).select("path", "length", "content")


def finalise(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of all shards' CSV files below a folder, and how many each source has."""
    pairs = _filled_columns(spark.read.csv(folder, header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv"))
    return pairs, pairs.groupBy("source").agg(F.count("*").alias("n"))


def write_features(frames: DataFrame, path: str) -> None:
    """The feature store: a row a frame, in folders by split and shard; a shard that is written again replaces itself alone."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "shard").parquet(path)


def missing_shards(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (split, shard) those that the store has no frame of."""
    return wanted.join(store.select("split", "shard").distinct(), ["split", "shard"], "left_anti")


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table below root/key; it is built only where it isn't complete yet."""
    path = f"{root.rstrip('/')}/{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out."""
    pairs.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    pairs.select(*PAIR.names).na.fill("").write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_pairs_parquet(pairs: DataFrame, path: str) -> None:
    pairs.select(*[F.col(c).cast("int" if c == "source" else "string") for c in PAIR.names]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_records(records: DataFrame, path: str, fmt: str) -> None:
    """jsonl, csv, text (id, tab, units), or json: one array in one file, which one task writes row by row."""
    out = records.write.mode("overwrite")
    if fmt == "jsonl":
        out.json(path)
    elif fmt == "csv":
        out.csv(path, header=True, escape='"')
    elif fmt == "text":
        records.select(F.concat_ws("\t", "id", "units")).write.mode("overwrite").text(path)
    elif fmt == "json":
        # an opening, the rows, a closing: the file is an array whose lines are its elements, and nothing is gathered
        line = F.concat(F.when(F.monotonically_increasing_id() > 0, ",").otherwise(""), F.to_json(F.struct("*")))
        edge = lambda mark: records.sparkSession.range(0, 1, 1, 1).select(F.lit(mark).alias("value"))
        rows = records.coalesce(1).select(line.alias("value"))
        edge("[").unionAll(rows).unionAll(edge("]")).coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: jsonl, json, csv or text")


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines that aren't blank, stripped; the limit counts those."""
    t = F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text")
    out = spark.read.text(path).select(t).where("text <> ''")
    return out.limit(limit) if limit is not None else out


def find_column(df: DataFrame, kind: str, override: str | None = None) -> str | None:
    """The audio or text column of a table: the one named, a binary (or struct with bytes) one, or the first hint. No audio column is an error."""
    names = df.columns
    if override:
        if override not in names:
            raise ValueError(f"no column {override!r}; there are {names}")
        return override
    if kind == "audio":
        for f in df.schema.fields:
            if isinstance(f.dataType, T.BinaryType) or isinstance(f.dataType, T.StructType) and "bytes" in f.dataType.names:
                return f.name
    found = next((h for h in (AUDIO_HINTS if kind == "audio" else TEXT_HINTS) if h in names), None)
    if found is None and kind == "audio":
        raise ValueError(f"no audio column; there are {names}")
    return found


def shard_filename(n_shards: Column, shard: Column) -> Column:
    return F.format_string("data/train-%05d-of-%05d.parquet", shard.cast("int"), n_shards.cast("int"))


def select_shards(n_shards: Column, n_used: Column) -> Column:
    """Evenly spaced shard numbers, half-even, distinct and sorted."""
    one = F.array(F.lit(0).cast("long"))
    even = F.transform(F.sequence(F.lit(0).cast("long"), n_used.cast("long") - 1), lambda i: F.bround(i * (n_shards - 1) / (n_used - 1)).cast("long"))
    return F.array_sort(F.array_distinct(F.when(n_used <= 1, one).otherwise(even)))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length of every file below root: a listing, contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def shards_with_features(files: DataFrame, splits: list[str]) -> DataFrame:
    """Manifests of the splits whose feature file exists: stem, split."""
    stem = lambda ext: F.regexp_extract("path", rf"([^/]+)\.{ext}$", 1)
    left = files.select(stem("npz").alias("stem")).where("stem <> ''")
    right = files.select(stem("npy").alias("stem")).where("stem <> ''")
    return left.join(right, "stem", "left_semi").withColumn("split", F.substring_index("stem", "_", 1)).where(F.col("split").isin(splits))


def transfer_inventory(files: DataFrame) -> DataFrame:
    """Files and bytes outside index/, by first folder."""
    kept = files.where("path not like '%/index/%'")
    return kept.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return registry.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)
