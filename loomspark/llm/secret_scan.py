"""Secret scans with a battery of randomness tests, in DataFrame functions alone.

Base patterns find assignments, access keys and hex runs. Beside them, each run of 20 token characters or more with a digit or
both cases is a candidate: its encoding is inferred from its characters, and three tests hold it against uniform random
symbols of that alphabet: chi-squared over eight equal bands (the alphabet is ordered so that common letters share bands), runs of a
kind of symbol, lag-one serial correlation; without a digit a fourth one asks whether upper and lower case are as frequent. The p-values
are combined as those of independent tests. A run's long pieces between slashes are candidates too.

All candidates of the corpus, each different one once, decide within each class of lengths what is reported as a span of kind `random`: what
the Benjamini-Hochberg rule at Q calls structured isn't; and of the rest, no more than leave the share of structured ones among the
reported at Q. That share is estimated, as those that are random have uniform p-values: from their number above SURE, where
structured ones are taken to be rare, it follows how many lie above any other p, and what lies there beside them is structured (one standard
deviation is allowed for). A piece is reported where the whole run isn't.

Texts are read once: what is found in them is written as a table, without the texts unless they are wanted. Not candidates: runs of
one case without a digit, and of fewer than 20 characters.

Spans are in code points, end exclusive, and cover the whole match. Defined results: null text is empty; an empty text has no spans;
repeated rows give the same spans each; a null id stays null; very long texts are scanned whole; with no candidates nothing is added; an
empty table gives no rows; other columns don't matter, and redact() returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import columns, cut, row

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Maximal runs of token characters, those of them that are candidates, and runs between slashes.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
MIXED = r"[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]"
PIECE = RUN.replace("/", "")
KINDS = ("assign", "access", "hex", "random")
#: Lengths at which classes begin, the share that is allowed, the p-value above which the random ones are counted, and bands of the chi-squared test.
CLASSES, Q, SURE, BANDS = (20, 28, 40, 56, 80), 0.05, 0.25, 8
#: p-values are counted by hundredths of their decimal logarithm, as far as 1e-16.
STEPS, LAST = 100, 1600
MARK = "[SECRET]"

#: Vowels first, then consonants as common as they are in English text.
_DIGITS, _LOWER = "0123456789", "aeioutnsrhldcmfpgwybvkxjqz"
_UPPER = _LOWER.upper()
#: Pattern and alphabet of each encoding, and the symbols whose runs are counted, narrowest first; the last takes the rest.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "aecdbf", "0-9"),
    ("^[0-9A-F]+$", _DIGITS + "AECDBF", "0-9"),
    ("^[A-Z2-7]+$", _UPPER + "234567", "AEIOUHRLWY"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER, "aeiouhrlwy"),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER, "AEIOUHRLWY"),
    ("^[A-Za-z]+$", _UPPER + _LOWER, "a-z"),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, "a-z"),
    ("^[0-9A-Za-z_-]+$", _DIGITS + _UPPER + _LOWER + "-_", "a-z"),
    ("", _DIGITS + _UPPER + _LOWER + "+/-_", "a-z"),
)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), s["out"]).otherwise(F.concat(s["out"], hit)).alias("out"))

    all_ = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), all_).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a rational approximation good to 1e-7 relative for what is tested here."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x - 1.26551223 + t * poly) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_random(token: Column) -> Column:
    """Combined p-value of the battery for the hypothesis that token is made of uniform random symbols of its encoding."""
    alphabet, counted = F.lit(ENCODINGS[-1][1]), F.lit(f"[^{ENCODINGS[-1][2]}]")
    for pattern, symbols, marks in reversed(ENCODINGS[:-1]):
        fits = token.rlike(pattern)
        alphabet, counted = F.when(fits, F.lit(symbols)).otherwise(alphabet), F.when(fits, F.lit(f"[^{marks}]")).otherwise(counted)
    # of one token: its symbols' ranks in the alphabet, their number, the alphabet's size, and which are of the kind whose runs are counted
    symbols = F.filter(F.split(token, ""), lambda c: c != "")
    number = lambda other: F.length(F.regexp_replace(token, other, "")).cast("double")
    base = F.array(F.struct(symbols.alias("c"), F.length(token).cast("double").alias("n"), alphabet.alias("a"), counted.alias("k"), number("[^A-Z]").alias("upper"), number("[^a-z]").alias("lower"), token.rlike("[0-9]").alias("digit")))
    ranked = F.transform(base, lambda s: F.struct(
        F.transform(s["c"], lambda c: (F.call_function("locate", c, s["a"]) - 1).cast("double")).alias("x"), F.transform(s["c"], lambda c: (~F.rlike(c, s["k"])).cast("int")).alias("high"),
        s["n"].alias("n"), F.length(s["a"]).cast("double").alias("m"), s["upper"].alias("upper"), s["lower"].alias("lower"), s["digit"].alias("digit")))

    def tests(s: Column) -> Column:
        x, n, m, high = s["x"], s["n"], s["m"], s["high"]
        bands = F.transform(x, lambda v: F.floor(v * BANDS / m))
        # eight bands of nearly equal size: what a band expects follows from the ranks that fall into it
        chi = F.aggregate(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), F.lit(0.0),
            lambda a, b: a + F.pow(F.size(F.filter(bands, lambda v: v == b)) - n * (F.ceil((b + 1) * m / BANDS) - F.ceil(b * m / BANDS)) / m, 2) / (n * (F.ceil((b + 1) * m / BANDS) - F.ceil(b * m / BANDS)) / m),
        )
        df = float(BANDS - 1)
        p_chi = normal_tail((F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(F.lit(2 / (9 * df))))
        n1 = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
        n2 = n - n1
        runs = F.aggregate(F.zip_with(high, F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, v: a + F.coalesce(v, F.lit(0)))
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        # with one kind alone, runs say nothing
        p_runs = F.when(var <= 0, F.lit(1.0)).otherwise(2 * normal_tail(F.abs((runs - mean) / F.sqrt(var))))
        mu = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        ss = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu))
        lag = F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: (a - mu) * (b - mu)), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
        p_serial = F.when(ss <= 0, F.lit(0.0)).otherwise(2 * normal_tail(F.abs((lag / ss + 1 / n) * F.sqrt(n))))
        p_case = 2 * normal_tail(F.abs(s["upper"] - s["lower"]) / F.sqrt(s["upper"] + s["lower"]))
        least, tried = F.least(p_chi, p_runs, p_serial), F.when(s["digit"], 3.0).otherwise(4.0)
        least = F.least(F.lit(1.0), F.when(s["digit"], least).otherwise(F.least(least, p_case)))
        return -F.expm1(tried * F.log1p(-F.least(least, F.lit(1 - 1e-12))))

    return F.transform(ranked, tests)[0]


def candidates(text: Column) -> Column:
    """array<struct<start, end, class, step, key, pieces>>: candidates with their class of lengths, the step of their p-value and a hash that tells them apart; pieces are such structs without pieces."""

    def judged(c: Column, at: Column) -> list[Column]:
        length = c["end"] - c["start"]
        kind = F.lit(0)
        for k, least in enumerate(CLASSES):
            kind = F.when(length >= least, F.lit(k)).otherwise(kind)
        step = F.least(F.floor(-F.log10(F.greatest(p_random(c["value"]), F.lit(1e-16))) * STEPS), F.lit(LAST)).cast("int")
        return [(at + c["start"]).alias("start"), (at + c["end"]).alias("end"), kind.alias("class"), step.alias("step"), F.xxhash64(c["value"]).alias("key")]

    mixed = lambda found: F.filter(found, lambda m: F.rlike(m["value"], F.lit(MIXED)))

    def one(c: Column) -> Column:
        found = F.when(F.contains(c["value"], F.lit("/")), mixed(matches(c["value"], PIECE))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        return F.struct(*judged(c, F.lit(0)), F.transform(found, lambda m: F.struct(*judged(m, c["start"]))).alias("pieces"))

    return F.transform(mixed(matches(text, RUN)), one)


def least_step(counts: dict[int, int]) -> int:
    """Of the counts of one class's candidates by step, the step at which they begin not to be reported."""
    total, sure = sum(counts.values()), int(-STEPS * math.log10(SURE))
    structured, below = LAST + 1, 0
    for step in sorted(counts, reverse=True):
        below += counts[step]
        if 10 ** (-step / STEPS) <= Q * below / total:
            structured = step
    random = sum(n for step, n in counts.items() if step < sure) / (1 - 10 ** (-sure / STEPS))
    allowed = math.sqrt(random * SURE / (1 - SURE))
    out = 0
    for step in sorted({*(s + 1 for s in counts), structured}):
        if step <= structured:
            reported = sum(n for s, n in counts.items() if s < step)
            if reported - random * (1 - 10 ** (-step / STEPS)) <= Q * reported + allowed:
                out = step
    return out


def thresholds(marked: DataFrame) -> dict[int, int]:
    """For each class of lengths the step at which candidates begin not to be reported, from all different candidates of `marked` (more)."""
    short = lambda c: F.struct(c["class"].alias("class"), c["step"].alias("step"), c["key"].alias("key"))
    each = F.flatten(F.transform("more", lambda c: F.concat(F.array(short(c)), F.transform(c["pieces"], short))))
    different = marked.where(F.size("more") > 0).select(F.explode(each).alias("c")).select("c.*").distinct()
    counts: dict[int, dict[int, int]] = {}
    for r in different.groupBy("class", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["class"], {})[r.step] = r.n
    return {k: least_step(c) for k, c in counts.items()}


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> by start, then kind; kind by its place in KINDS."""
    tagged = lambda k, found: F.transform(found, lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"]))
    assigned = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)
    return F.array_sort(F.concat(tagged(0, assigned), tagged(1, matches(text, ACCESS)), tagged(2, matches(text, HEX))))


def spanned(docs: DataFrame, *carried: Column, text_col: str = "text") -> DataFrame:
    """The carried columns of every row of docs, base and spans, each array<struct<start, kind, end>> by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = cut(docs.select(*carried, base_spans(text).alias("base"), candidates(text).alias("more")))
    least = thresholds(marked)
    random = lambda c: c["step"] < _limit(c["class"], least, F.lit(0))
    place = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))
    found = F.flatten(F.transform("more", lambda c: F.when(random(c), F.array(place(c))).otherwise(F.transform(F.filter(c["pieces"], random), place))))
    free = F.filter(found, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.transform(free, lambda c: F.struct(c["start"], F.lit(3).alias("kind"), c["end"]))
    return marked.withColumn("spans", F.array_sort(F.concat("base", added))).drop("more")


def _limit(kind: Column, least: dict[int, int], limit: Column) -> Column:
    for k, step in least.items():
        limit = F.when(kind == k, F.lit(step)).otherwise(limit)
    return limit


def joined(found: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans of every row of docs."""
    return spanned(docs, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_col=text_col)


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with MARK in the place of every secret; all rows and columns stay, count_col follows the text where there is one."""
    found = spanned(docs, row(docs).alias("row"), text_col=text_col)
    old = F.col("row")[text_col].cast("string")

    def step(s: Column, x: Column) -> Column:
        fresh = x["end"] > s["at"]
        start = F.greatest(x["start"], s["at"])
        out = F.concat(s["out"], F.when(fresh & (x["start"] >= s["at"]), F.concat(F.substring(old, s["at"] + 1, start - s["at"]), F.lit(MARK))).otherwise(F.lit("")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    folded = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    new = F.when(F.size("spans") > 0, F.concat(folded["out"], F.substring(old, folded["at"] + 1, F.lit(2**31 - 1)))).otherwise(F.col("row")[text_col])
    out = found.select("row", "spans", new.alias("new"))
    changed = {text_col: F.col("new").alias(text_col)}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.size("spans") > 0, F.length("new").cast(docs.schema[count_col].dataType)).otherwise(F.col("row")[count_col]).alias(count_col)
    return out.select(*[changed.get(c, col) for c, col in zip(docs.columns, columns(docs, "row"), strict=True)])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
