"""Registered queries of the sequence-data operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.distance import cer, edit_distance, wer
from loomspark.functions.hashing import split_of, subset_of, text_bucket, unit_interval
from loomspark.functions.text import TWI
from loomspark.operators import decode, frames, metrics, pairs, runs, sampling, stats
from loomspark.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where a scan of few files gives fewer; for rows that cost more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_FOLD_SRC = "".join(TWI.fold) + TWI.apostrophes.replace("'", "''")
_NORM = f"trim(regexp_replace(regexp_replace(translate(lower(strip_accents(text)), '{_FOLD_SRC}', '{''.join(TWI.fold.values())}'), '\\S*\\p{{Nd}}\\S*', ' ', 'g'), '[^{TWI.alphabet}]+', ' ', 'g'))"
_UNITS = f"regexp_extract_all({_NORM}, '{TWI.pattern}')"
_WORDS = f"list_transform(list_filter(string_split({_NORM}, ' '), lambda w: w <> ''), lambda w: regexp_extract_all(w, '{TWI.pattern}'))"
_INV = "[" + ", ".join(f"'{u}'" for u in TWI.inventory) + "]"


@query(f"WITH u AS (SELECT doc_id, {_UNITS} AS u, {_WORDS} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n_words, len(u)::INTEGER AS n_units, md5(array_to_string(u, ' ')) AS units_md5 FROM u")
def text_to_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", TWI.segment(F.col("text")).alias("w")).withColumn("u", F.flatten("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size("u").alias("n_units"), F.md5(F.array_join("u", " ").cast("binary")).alias("units_md5"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: array_to_string(x, ' ')), ' | ')) AS words_md5, CASE WHEN len(w) = 0 THEN 2 ELSE 1 + len(w) + len(flatten(w)) END::INTEGER AS n_tokens, md5('<star> ' || CASE WHEN len(w) = 0 THEN '<star>' ELSE array_to_string(list_transform(w, lambda x: array_to_string(x, ' ') || ' <star>'), ' ') END) AS tokens_md5 FROM w")
def text_to_units_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", TWI.segment(F.col("text")).alias("w"))
    d = d.withColumn("t", TWI.tokens_starred(F.col("w")))
    words = F.array_join(F.transform("w", lambda x: F.array_join(x, " ")), " | ")
    return d.select("doc_id", F.md5(words.cast("binary")).alias("words_md5"), F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH u AS (SELECT unnest({_UNITS}) AS unit FROM documents), n AS (SELECT unit, count(*) AS n FROM u GROUP BY unit) SELECT unit, n, regexp_replace(translate(unit, 'ɛɔ', 'eo'), '[^a-z]', '', 'g') AS roman, trim(regexp_replace(regexp_replace(translate(unit, 'ɛɔ', 'eo'), '[^a-z]', '', 'g'), '(.)', '\\1 ', 'g')) AS token FROM n")
def romanize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select(F.explode(TWI.units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return n.select("unit", "n", TWI.romanize_unit(F.col("unit")).alias("roman"), TWI.aligner_token(F.col("unit")).alias("token"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN source IN ('src3', 'src5') THEN 'source' WHEN length(trim(coalesce(text, ''))) < 200 THEN 'short' WHEN quality = 0 THEN 'quality' ELSE 'kept' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason""")
def pair_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    gate = pairs.pair_gate(F.col("source"), F.col("text"), F.lit(None).cast("double"), ["src3", "src5"], 200, 1.0).when(F.col("quality") == 0, "quality")
    return stats.skip_counts(j.select(F.coalesce(gate, F.lit("kept")).alias("reason")), "reason")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' OR text IS NULL THEN 'empty_text' WHEN value IS NULL THEN 'decode_error' WHEN value < 0.4 OR value > 31 THEN 'duration' WHEN length(text) < 3 THEN 'few_units' WHEN length(text) / value < 3 OR length(text) / value > 32 THEN 'rate' ELSE 'kept' END AS reason
FROM (SELECT event_type || props AS text, value FROM events)) GROUP BY reason""")
def utterance_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", "props").alias("text"), "value")
    gate = pairs.utterance_gate(F.col("text"), F.col("value"), F.char_length("text"))
    return stats.skip_counts(e.select(F.coalesce(gate, F.lit("kept")).alias("reason")), "reason")


@query("""WITH b AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'clean-text' ELSE 'real' END AS origin, ('0x' || substr(md5(text), 1, 8))::BIGINT % 100 AS bucket FROM documents)
SELECT doc_id, bucket, CASE WHEN origin = 'clean-text' THEN 'train' WHEN bucket < 2 THEN 'val' WHEN bucket < 4 THEN 'test' ELSE 'train' END AS split FROM b""")
def hash_split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("origin", F.when(F.col("source") == "src1", "clean-text").otherwise("real"))
    return d.select("doc_id", text_bucket(F.col("text")).alias("bucket"), split_of(F.col("text"), F.col("origin")).alias("split"))


@query("""WITH b AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0::FLOAT ELSE (('0x' || substr(md5(user_id || ':' || event_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)::FLOAT END AS b FROM events)
SELECT event_id, CASE WHEN b < 0.1::FLOAT THEN 'val' WHEN b < 0.2::FLOAT THEN 'test' ELSE 'train' END AS subset FROM b""")
def hash_split_utt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    b = F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(unit_interval(F.concat_ws(":", "user_id", "event_id"))).cast("float")
    return e.select("event_id", subset_of(b, 0.1, 0.1).alias("subset"))


_TURNS = f"SELECT conv_id, turn, text, {_UNITS} AS u FROM conversations"
_PREV = f"t AS ({_TURNS}), p AS (SELECT a.conv_id, a.turn, a.u AS hyp, b.u AS ref FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1), e AS (SELECT conv_id, turn, len(hyp) AS hyp_len, len(ref) AS ref_len, levenshtein(array_to_string(list_transform(hyp, lambda x: chr((47 + list_position({_INV}, x))::INTEGER)), ''), array_to_string(list_transform(ref, lambda x: chr((47 + list_position({_INV}, x))::INTEGER)), '')) AS edits FROM p)"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", TWI.units(F.col("text")).alias("u"))
    p = spread(t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("u").alias("ref")).join(t.withColumnRenamed("u", "hyp"), ["conv_id", "turn"]))
    return p.select("conv_id", "turn", F.size("hyp").cast("long").alias("hyp_len"), F.size("ref").cast("long").alias("ref_len"), edit_distance(F.col("hyp"), F.col("ref")).cast("long").alias("edits"))


@query(f"WITH {_PREV} SELECT conv_id, turn, hyp_len, ref_len, edits FROM e")
def pair_uer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir)


@query(f"WITH {_PREV} SELECT count(*) AS pairs, round(sum(edits) / greatest(sum(ref_len), 1), 9) AS micro, round(avg(CASE WHEN ref_len = 0 THEN 1.0 ELSE edits / ref_len END), 9) AS macro, round(sum(hyp_len) / greatest(sum(ref_len), 1), 9) AS length_ratio FROM e")
def corpus_uer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.corpus_rates(_turn_pairs(spark, sf_dir))
    return r.select("pairs", *[F.round(c, 9).alias(c) for c in ("micro", "macro", "length_ratio")])


@query()
def cer_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ref"))
    p = t.select("conv_id", (F.col("turn") + 1).alias("turn"), "ref").join(t.withColumnRenamed("ref", "hyp"), ["conv_id", "turn"])
    return p.select("conv_id", "turn", cer(F.col("hyp"), F.col("ref")).alias("cer"), wer(F.col("hyp"), F.col("ref")).alias("wer"))


_SYN = "(SELECT count(*) FROM benchmark)"


def _mixed_sql(take: str, quota: str) -> str:
    return f"""WITH k AS (SELECT {take} AS take), n AS (SELECT lang AS s, count(*) AS n, row_number() OVER (ORDER BY lang) AS i FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total, count(*) AS k FROM n),
q AS (SELECT s, least({quota}, n)::BIGINT AS quota FROM n, t, k),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents),
c AS (SELECT doc_id, lang, r <= quota AS chosen FROM r JOIN q ON q.s = r.lang),
x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('8:' || doc_id), doc_id) AS r FROM c WHERE NOT chosen)
SELECT doc_id, lang FROM c WHERE chosen UNION ALL SELECT doc_id, lang FROM x WHERE r <= (SELECT take FROM k) - (SELECT sum(quota) FROM q)"""


def _drawn(spark: SparkSession, sf_dir: str, times: int, balance: str) -> DataFrame:
    take = times * table(spark, sf_dir, "benchmark").count()
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", take, balance, 7)


@query(_mixed_sql(f"3 * {_SYN}", "round_even(take * n / total, 0)"))
def mix_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, 3, "proportional")


@query(_mixed_sql(f"11 * {_SYN}", "take // k + CASE WHEN i <= take % k THEN 1 ELSE 0 END"))
def mix_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, 11, "equal")


@query("""WITH s AS (SELECT count(*) AS synthetic FROM benchmark), d AS (SELECT count(*) AS available FROM documents)
SELECT synthetic::INTEGER AS synthetic, available::INTEGER AS available, least(2 * synthetic, available)::INTEGER AS used, 2 * synthetic >= available AS capped, (synthetic + least(2 * synthetic, available))::INTEGER AS total FROM s, d""")
def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("synthetic").alias("lang"))
    _, report = sampling.mix(syn, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "lang", "doc_id", 2.0, "proportional", 7)
    return report.select("synthetic", "available", "used", "capped", "total")


_HUMAN = "('src0', 'src1', 'src2', 'src3')"


@query(f"""WITH h AS (SELECT doc_id, source FROM documents WHERE source IN {_HUMAN}), m AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS r FROM documents WHERE source NOT IN {_HUMAN})
SELECT doc_id, source FROM h UNION ALL SELECT doc_id, source FROM m WHERE r <= floor((SELECT count(*) FROM h) * 0.5)""")
def machine_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.machine_cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["src0", "src1", "src2", "src3"], "doc_id", 0.5, 3)


@query("""WITH p AS (SELECT doc_id, text FROM documents WHERE lang = 'de' AND text <> ''), x AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) AS r FROM p)
SELECT doc_id, 'real' AS origin FROM documents UNION ALL SELECT doc_id, 'clean-ref' AS origin FROM x WHERE r <= least(floor((SELECT count(*) FROM documents) * 0.05), (SELECT count(*) FROM p))""")
def clean_ref_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", F.col("text")).alias("reference_units"), F.lit("").alias("source_text"), F.lit("real").alias("origin"))
    return sampling.clean_ref_augment(d, "doc_id", 0.05, 5).select("doc_id", "origin")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id), event_id) AS r FROM events) WHERE r <= 50")
def cap_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_per_group(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 50)


_SPANS = "spans AS (SELECT *, epoch_us(ts) // 60000000 AS m FROM events), d AS (SELECT user_id, event_type AS unit, value, m AS s, lead(m) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM spans), u AS (SELECT * FROM d WHERE e IS NOT NULL)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("m", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.col("event_type").alias("unit"), F.col("value"), F.col("m").alias("start"), F.lead("m").over(w).alias("end")).where("end is not null")


@query(f"""WITH {_SPANS}, k AS (SELECT unit, sum(e - s)::BIGINT AS frames, count(*) AS occurrences FROM u WHERE value >= 10 GROUP BY unit HAVING count(*) >= 20)
SELECT row_number() OVER (ORDER BY unit)::INTEGER AS class, unit, frames, occurrences FROM k UNION ALL SELECT 0, '<sil>', 0, 0""")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary(_spans(spark, sf_dir).withColumnRenamed("value", "score"), 20, 10.0)


@query(f"""WITH {_SPANS} SELECT unit, user_id % 4 AS part, count(*) AS n, round(avg(e - s), 6) AS mean, round(quantile_cont((e - s)::DOUBLE, 0.05), 6) AS p5, round(quantile_cont((e - s)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont((e - s)::DOUBLE, 0.99), 6) AS p99, round(100 * avg(CASE WHEN e - s < 60 THEN 1.0 ELSE 0.0 END), 6) AS below_60
FROM u GROUP BY GROUPING SETS ((user_id % 4), (user_id % 4, unit))""")
def unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _spans(spark, sf_dir).select((F.col("user_id") % 4).alias("part"), "unit", (F.col("end") - F.col("start")).cast("double").alias("d"))
    s = stats.unit_stats(u, "part", "unit", "d", (60.0,))
    p = lambda k: F.round(F.col("percentiles")[k], 6)
    return s.select("unit", "part", "n", F.round("mean", 6).alias("mean"), p(0).alias("p5"), p(2).alias("p50"), p(5).alias("p99"), F.round("below_0", 6).alias("below_60"))


@query(f"WITH {_SPANS}, m AS (SELECT unit, median((e - s)::DOUBLE) AS m FROM u GROUP BY unit), v AS (SELECT DISTINCT event_type AS unit FROM events UNION ALL SELECT 'never') SELECT unit, coalesce(m, 0.0) AS median_frames FROM v LEFT JOIN m USING (unit)")
def unit_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.col("event_type").alias("unit")).distinct().unionByName(spark.createDataFrame([("never",)], "unit string")).withColumn("class", F.col("unit"))
    return stats.medians(_spans(spark, sf_dir), v).select(F.col("class").alias("unit"), "median_frames")


@query("SELECT source, count(*) AS utterances, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean_score, count(DISTINCT lang) AS shards FROM documents GROUP BY source")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_summary(table(spark, sf_dir, "documents"), "source", "n_chars", "n_chars", "lang").withColumn("mean_score", F.round("mean_score", 6))


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT count(x) AS n, round(avg(x), 9) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)), 9) AS std FROM x")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.norm_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("SELECT l_returnflag || l_linestatus AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS pct FROM lineitem GROUP BY 1")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"))
    return stats.histogram(l, "label").withColumn("pct", F.round("pct", 9))


@query("WITH n AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1), w AS (SELECT label, n, pow(sum(n) OVER () / greatest(n, 1)::DOUBLE, 0.5) AS w FROM n) SELECT label, n, round(w / avg(w) OVER (), 9) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return metrics.class_weights(n, 0.5).withColumn("weight", F.round("weight", 9))


_CONF = "p AS (SELECT event_type AS ref, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events), c AS (SELECT ref, pred, count(*) AS n FROM p WHERE pred IS NOT NULL GROUP BY 1, 2)"
_REPORT = f"""WITH {_CONF}, s AS (SELECT ref AS class, sum(n) AS support, sum(n) FILTER (ref = pred) AS hits FROM c GROUP BY 1), q AS (SELECT pred AS class, sum(n) AS predicted FROM c GROUP BY 1),
r AS (SELECT class, coalesce(support, 0)::BIGINT AS support, coalesce(predicted, 0)::BIGINT AS predicted, coalesce(hits, 0)::BIGINT AS hits FROM s FULL JOIN q USING (class)),
f AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM r)"""


def _confused(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("ref"), F.lead("event_type").over(w).alias("pred")).where("pred is not null")
    return metrics.confusion(p)


@query(f"WITH {_CONF} SELECT ref, pred, n FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confused(spark, sf_dir)


@query(f"{_REPORT} SELECT class, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.class_report(_confused(spark, sf_dir))
    return r.select("class", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_REPORT} SELECT round(sum(hits) / sum(support), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 9) AS macro_f1 FROM f")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.summary(metrics.class_report(_confused(spark, sf_dir)))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(f"WITH {_CONF}, k(a, b) AS (VALUES ('click', 'view'), ('error', 'purchase')), j AS (SELECT * FROM c JOIN k ON ref = a OR ref = b) SELECT a, b, sum(n) FILTER (ref = a)::BIGINT AS support_a, sum(n) FILTER (ref = b)::BIGINT AS support_b, round(sum(n) FILTER (ref = a AND pred = a) / sum(n) FILTER (ref = a), 9) AS recall_a, round(sum(n) FILTER (ref = a AND pred = b) / sum(n) FILTER (ref = a), 9) AS a_as_b FROM j GROUP BY a, b")
def contrast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame([("click", "view"), ("error", "purchase")], "a string, b string")
    c = metrics.contrasts(_confused(spark, sf_dir), k)
    return c.select("a", "b", "support_a", "support_b", F.round("recall_a", 9).alias("recall_a"), F.round("a_as_b", 9).alias("a_as_b"))


_POST = "i AS (SELECT label AS utt, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT utt, t, unnest(e) AS p, generate_subscripts(e, 1) - 1 AS class FROM i)"
_BEST = "a AS (SELECT utt, t, arg_max(class, {p} - class * 1e-30) AS class0, max({p}) AS p FROM {f} GROUP BY utt, t), best AS (SELECT a.utt, a.t, min(f.class) AS class, any_value(a.p) AS p FROM a JOIN {f} f ON f.utt = a.utt AND f.t = a.t AND f.{p} = a.p GROUP BY 1, 2)"
_RUNS = "n AS (SELECT *, CASE WHEN lag(class) OVER w = class THEN 0 ELSE 1 END AS new FROM best WINDOW w AS (PARTITION BY utt ORDER BY t)), m AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY t) AS run FROM n), r AS (SELECT utt, any_value(class) AS class, min(t) AS start, count(*) AS n, avg(p) AS confidence FROM m GROUP BY utt, run)"


def _smooth_sql(w: int) -> str:
    back, ahead = w // 2, w - 1 - w // 2
    return f"""z AS (SELECT *, row_number() OVER pw - 1 AS i, count(*) OVER (PARTITION BY utt, class) AS cnt, first_value(p) OVER pw AS fp, last_value(p) OVER (PARTITION BY utt, class ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lp, sum(p) OVER (PARTITION BY utt, class ORDER BY t ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS sp FROM g WINDOW pw AS (PARTITION BY utt, class ORDER BY t)),
s AS (SELECT utt, t, class, (sp + greatest({back} - i, 0) * fp + greatest(i + {ahead} - (cnt - 1), 0) * lp) / {w} AS p FROM z)"""


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("utt"), t.cast("long").alias("t"), "embedding")
    return e.select("utt", "t", F.posexplode("embedding").alias("class", "p")).withColumn("p", F.col("p").cast("double"))


@query(f"WITH {_POST}, {_smooth_sql(4)} SELECT utt, class::INTEGER AS class, count(*) AS n, round(sum(p), 6) AS total, round(sum(p * t), 5) AS moment FROM s GROUP BY utt, class")
def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = decode.smooth(_posteriors(spark, sf_dir), 4)
    return s.groupBy("utt", "class").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("total"), F.round(F.sum(F.col("p") * F.col("t")), 5).alias("moment"))


@query(f"WITH {_POST}, {_BEST.format(p='p', f='g')}, {_RUNS} SELECT utt, class::INTEGER AS class, start, n, round(confidence, 7) AS confidence FROM r WHERE n >= 1 AND confidence >= 0.2")
def argmax_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decode.runs(decode.argmax(_posteriors(spark, sf_dir)), 1, 0.2)
    return r.select("utt", "class", "start", "n", F.round("confidence", 7).alias("confidence"))


@query(f"WITH {_POST}, {_smooth_sql(7)}, {_BEST.format(p='p', f='s')}, {_RUNS}, k AS (SELECT *, greatest(1, least(3, round_even(n / 2.0, 0)))::INTEGER AS reps FROM r WHERE n >= 2 AND class <> 0) SELECT utt, class::INTEGER AS class, start, n, reps FROM k")
def decoded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decode.runs(decode.argmax(decode.smooth(_posteriors(spark, sf_dir), 7)), 2, -1.0, 0)
    med = r.select("class").distinct().withColumn("median_frames", F.lit(2.0))
    return decode.split_long(r, med).where("r = 0").select("utt", "class", "start", "n", "reps")


@query(f"""WITH {_POST}, grid(w, k) AS (VALUES (3, 1), (3, 2), (5, 1), (5, 2)), one AS (SELECT 3 AS w, * FROM (WITH {_smooth_sql(3)}, {_BEST.format(p='p', f='s')}, {_RUNS} SELECT utt, n FROM r) UNION ALL SELECT 5 AS w, * FROM (WITH {_smooth_sql(5)}, {_BEST.format(p='p', f='s')}, {_RUNS} SELECT utt, n FROM r))
SELECT grid.w, grid.k, count(n) AS runs, sum(n)::BIGINT AS frames FROM grid JOIN one ON one.w = grid.w AND one.n >= grid.k GROUP BY 1, 2""")
def decode_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = _posteriors(spark, sf_dir)
    grid = spark.createDataFrame([(3, 1), (3, 2), (5, 1), (5, 2)], "w int, k int")
    each = [decode.runs(decode.argmax(decode.smooth(post, w)), 1, -1.0).select(F.lit(w).alias("w"), "n") for w in (3, 5)]
    j = each[0].unionByName(each[1]).join(F.broadcast(grid), "w").where("n >= k")
    return j.groupBy("w", "k").agg(F.count("*").alias("runs"), F.sum("n").alias("frames"))


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, ts, event_id FROM events)
SELECT user_id, count(*) FILTER (event_type <> 'error')::INTEGER AS n, md5(coalesce(string_agg(event_type, ' ' ORDER BY ts, event_id) FILTER (event_type <> 'error'), '')) AS seq_md5 FROM e WHERE p IS NULL OR p <> event_type GROUP BY user_id""")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["error", "click", "purchase", "signup", "view"]
    cls = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).cast("int") - 1
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", cls.alias("c")))), lambda r: r["c"])
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("seq")).withColumn("out", decode.collapse(F.col("seq"), 0))
    text = F.array_join(F.transform("out", lambda c: F.element_at(F.array(*map(F.lit, names)), c + 1)), " ")
    return g.select("user_id", F.size("out").alias("n"), F.md5(text.cast("binary")).alias("seq_md5"))


_TRACK = """s AS (SELECT event_id AS k, user_id AS utt, (epoch_us(ts) // 3600000000) % 720 AS s, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'error' THEN -100 ELSE 3 END AS label, 1 + event_id % 4 AS d FROM events),
f AS (SELECT u.utt, t.t, ((u.utt * 31 + t.t * 17) % 101)::DOUBLE AS energy FROM (SELECT DISTINCT utt FROM s) u, range(0, 724) t(t)),
p AS (SELECT f.utt, f.t, arg_max(s.label, s.k) AS label FROM f JOIN s ON s.utt = f.utt AND f.t >= s.s AND f.t < s.s + s.d GROUP BY 1, 2),
b AS (SELECT f.*, p.label FROM f LEFT JOIN p USING (utt, t)),
q AS (SELECT utt, quantile_cont(energy, 0.5) AS floor, count(*) AS nc FROM b WHERE label IS NOT NULL GROUP BY utt),
i AS (SELECT *, CASE WHEN label IS NULL THEN sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY utt ORDER BY t) END AS g FROM b),
z AS (SELECT *, count(*) OVER (PARTITION BY utt, g) AS gap FROM i),
k AS (SELECT z.utt, z.t, z.label AS l0, CASE WHEN z.label IS NOT NULL THEN 'unit' WHEN gap < 5 THEN 'short_gap' WHEN coalesce(nc, 0) < 20 OR energy < floor THEN 'silence' ELSE 'loud_gap' END AS kind FROM z LEFT JOIN q USING (utt)),
track AS (SELECT utt, t, CASE WHEN l0 IS NOT NULL THEN l0 WHEN kind = 'silence' THEN 0 ELSE -100 END AS label, kind FROM k)"""


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000) % 720
    label = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", -100).otherwise(3)
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("utt"), hour.alias("start"), (hour + 1 + F.col("event_id") % 4).alias("end"), label.alias("label"))
    t = s.select("utt").distinct().select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(723).cast("long"))).alias("t")).withColumn("energy", ((F.col("utt") * 31 + F.col("t") * 17) % 101).cast("double"))
    return frames.label_track(t, frames.paint(s), 5, 50.0)


@query(f"WITH {_TRACK} SELECT utt, count(*) FILTER (kind = 'silence') AS silence, count(*) FILTER (kind = 'short_gap') AS short_gap, count(*) FILTER (kind = 'loud_gap') AS loud_gap, sum(CASE WHEN label >= 0 THEN label * (t + 1) ELSE 0 END)::BIGINT AS checksum FROM track GROUP BY utt")
def label_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return _track(spark, sf_dir).groupBy("utt").agg(n("silence"), n("short_gap"), n("loud_gap"), F.sum(F.when(F.col("label") >= 0, F.col("label") * (F.col("t") + 1)).otherwise(0)).cast("long").alias("checksum"))


@query(f"WITH {_TRACK} SELECT count(*) FILTER (kind = 'silence') AS silence, count(*) FILTER (kind = 'short_gap') AS short_gap, count(*) FILTER (kind = 'loud_gap') AS loud_gap, count(*) FILTER (label >= 0) AS labelled, count(*) AS frames FROM track")
def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.track_stats(_track(spark, sf_dir))


_CHUNKS = "SELECT {i} AS utt, unnest(CASE WHEN {n} <= {c} THEN [0::BIGINT] ELSE list_distinct(list_append(generate_series(0::BIGINT, {n} - {c}, {s}::BIGINT), {n} - {c})) END) AS start, least({n}, {c})::BIGINT AS valid_len FROM {f} WHERE {n} > 0"


@query(_CHUNKS.format(i="doc_id", n="n_chars", c=200, s=100, f="documents"))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("n_frames")), 200, 100)


@query(f"WITH {_TRACK}, c AS (SELECT utt, unnest(list_distinct(list_append(generate_series(0, 624, 50), 624))) AS start FROM (SELECT DISTINCT utt FROM s)) SELECT label::INTEGER AS label, count(*) AS n FROM c JOIN track ON track.utt = c.utt AND t >= start AND t < start + 100 WHERE label >= 0 GROUP BY 1")
def chunk_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = _track(spark, sf_dir)
    c = frames.chunks(table(spark, sf_dir, "events").select(F.col("user_id").alias("utt")).distinct().withColumn("n_frames", F.lit(724).cast("long")), 100, 50)
    return frames.chunk_label_counts(c, track)


@query("SELECT doc_id, source, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS off FROM documents")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars").select("doc_id", "source", "off")


@query("""WITH o AS (SELECT unit, row_number() OVER (ORDER BY unit) AS c FROM (SELECT DISTINCT event_type AS unit FROM events WHERE event_type <> 'view')), n AS (SELECT unit, row_number() OVER (ORDER BY unit) AS c FROM (SELECT DISTINCT event_type AS unit FROM events WHERE event_type <> 'click'))
SELECT unit, CASE WHEN o.c IS NULL THEN 'new' WHEN n.c IS NULL THEN 'dropped' ELSE 'transferred' END AS status, o.c::INTEGER AS old_class, n.c::INTEGER AS new_class FROM o FULL JOIN n USING (unit)""")
def vocab_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda x: table(spark, sf_dir, "events").where(F.col("event_type") != x).select(F.col("event_type").alias("unit")).distinct().withColumn("class", F.row_number().over(Window.orderBy("unit")))
    return stats.vocab_remap(names("view"), names("click")).select("unit", "status", "old_class", "new_class")


@query("SELECT substr(sha1(string_agg(s || ':' || n, '' ORDER BY s || ':' || n)), 1, 12) AS fingerprint FROM (SELECT source AS s, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1)")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.functions.hashing import fingerprint as of

    return of(table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")), "source", "n")


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY CAST(ts AS DATE)) AS i, round(avg(value), 6) AS m FROM events GROUP BY CAST(ts AS DATE)),
r AS (SELECT i, m AS best, 0 AS stale FROM d WHERE i = 1 UNION ALL SELECT d.i, CASE WHEN d.m > r.best + 0.01 THEN d.m ELSE r.best END, CASE WHEN d.m > r.best + 0.01 THEN 0 ELSE r.stale + 1 END FROM r JOIN d ON d.i = r.i + 1 WHERE r.stale < 5)
SELECT arg_max(best, i) AS best, max(CASE WHEN stale >= 5 THEN i - 1 END)::INTEGER AS stop FROM r""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))
    return decode.early_stop(d, "day", "m", 0.01, 5)


@query("WITH k(source, kind) AS (VALUES ('src0', 'studio'), ('src1', 'radio'), ('src2', 'film')) SELECT doc_id, coalesce(kind, 'unknown') AS kind FROM documents LEFT JOIN k USING (source)")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame([("src0", "studio"), ("src1", "radio"), ("src2", "film")], "source string, kind string")
    return table(spark, sf_dir, "documents").join(k, "source", "left").select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"))


@query("SELECT p_partkey, format('data/train-{:05d}-of-{:05d}.parquet', p_partkey % p_size, p_size) AS name FROM part WHERE p_size > 0")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", io.shard_filename(F.col("p_size"), F.col("p_partkey") % F.col("p_size")).alias("name"))


@query("""WITH p AS (SELECT p_partkey, p_size + 10 AS n, 2 + p_partkey % 9 AS k FROM part), s AS (SELECT DISTINCT p_partkey, round_even(i * (n - 1)::DOUBLE / (k - 1), 0)::BIGINT AS shard FROM (SELECT *, unnest(range(0, k)) AS i FROM p))
SELECT p_partkey, string_agg(shard, ',' ORDER BY shard) AS shards FROM s GROUP BY p_partkey""")
def shard_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(io.select_shards(F.col("p_size") + 10, 2 + F.col("p_partkey") % 9), ",").alias("shards"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
r AS (SELECT doc_id, source, n, i, 0 AS batch, 1 AS c FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.source, o.n, o.i, CASE WHEN o.n * (r.c + 1) > 50000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN o.n * (r.c + 1) > 50000 THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
SELECT doc_id, source, n AS n_chars, batch::INTEGER AS batch FROM r""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.length_batches(d, "source", "n_chars", "doc_id", 50_000).withColumnRenamed("_batch", "batch")


@query(f"WITH u AS (SELECT doc_id, source, {_UNITS} AS u FROM documents) SELECT source, count(*) AS docs, sum(len(u))::BIGINT AS units FROM u WHERE len(u) >= 5 GROUP BY source")
def units_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: raw text to units, gated, counted by source."""
    d = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", F.size(TWI.units(F.col("text"))).alias("n")).where("n >= 5")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("units"))


@query()
def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.functions.audio import log_mel_udf
    from loomspark.session import ship

    ship(spark)
    tone = F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda i: F.sin(i * (F.coalesce("value", F.lit(0.0)) + 1) / 500).cast("float"))
    e = spread(table(spark, sf_dir, "events").select("event_id", "value")).select("event_id", log_mel_udf(tone).alias("mel"))
    return e.select("event_id", F.size("mel").alias("frames"), F.round(F.aggregate(F.flatten("mel"), F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("SELECT a.doc_id, a.source, row_number() OVER (ORDER BY md5('1:' || a.doc_id), a.doc_id)::INTEGER AS place FROM documents a")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a seeded shuffle: ranks come from range partitions and their sizes, not from one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.places(d, "doc_id", 1).select("doc_id", "source", F.col("place").cast("int").alias("place"))


_PROBE = "h AS (SELECT (user_id % 7)::INTEGER AS class, CASE event_id % 4 WHEN 0 THEN -1 ELSE 20 * (event_id % 4)::INTEGER END AS margin, CASE WHEN coalesce(value, 0) >= 30 THEN 1 ELSE 0 END AS hit FROM events)"


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("int").alias("class"), F.when(m != 0, 20 * m.cast("int")).alias("margin"), (F.coalesce("value", F.lit(0.0)) >= 30).alias("hit"))


@query(f"WITH {_PROBE} SELECT margin, class, count(*) AS n, round(avg(hit), 9) AS accuracy FROM h GROUP BY GROUPING SETS ((margin), (margin, class)) HAVING grouping(class) = 1 OR count(*) >= 20")
def probe_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.probe_report(_probed(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {_PROBE}, k(a, b) AS (VALUES (1, 2), (0, 5)) SELECT a, b, margin, count(*) AS n, round(avg(hit), 9) AS accuracy FROM h JOIN k ON class IN (a, b) GROUP BY a, b, margin")
def probe_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(1, 2), (0, 5)], "a int, b int")
    return runs.probe_contrasts(_probed(spark, sf_dir), pairs).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT p_partkey, round(CASE WHEN p_partkey < 100 THEN p_partkey / 100 ELSE 0.5 * (1 + cos(pi() * least(1.0, (p_partkey - 100) / 1400))) END, 9) AS rate FROM part")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(runs.learning_rate(F.col("p_partkey"), 1500, 100), 9).alias("rate"))


@query("SELECT event_type, sum(user_id % 9 + 1)::BIGINT AS n, round(sum(value * (user_id % 9 + 1)) / sum(user_id % 9 + 1), 6) AS loss FROM events GROUP BY event_type")
def training_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 9 + 1).alias("n"), F.col("value").alias("loss"))
    return runs.running_mean(e, "event_type", "n", "loss").withColumn("loss", F.round("loss", 6))


@query("""WITH w(artifact, pattern) AS (VALUES ('first', '%src1%'), ('second', '%src2%'), ('never', '%none%')), f AS (SELECT source || '/' || lang AS path, n_chars AS length FROM documents)
SELECT artifact, count(path) AS files, coalesce(sum(length), 0)::BIGINT AS bytes, count(path) > 0 AS found FROM w LEFT JOIN f ON path LIKE pattern GROUP BY artifact""")
def which_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame([("first", "%src1%"), ("second", "%src2%"), ("never", "%none%")], "artifact string, pattern string")
    return runs.artifacts(want, table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.col("n_chars").cast("long").alias("length")))


@query()
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    return runs.text_scores(t.select("conv_id", (F.col("turn") + 1).alias("turn"), "ref").join(t.withColumnRenamed("ref", "hyp"), ["conv_id", "turn"]), "hyp", "ref")


@query()
def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by best class of an untrained tagger over a tone for each event, every eighth one of them several times as long as the network sees: mel, network, argmax and runs of an utterance at one go, so only its runs come back."""
    from loomspark.functions.audio import log_mel_udf, tone_udf
    from loomspark.functions.tagger import posteriors_udf, random_tagger, runs_udf
    from loomspark.session import ship

    ship(spark)
    tone = tone_udf(F.coalesce("value", F.lit(0.0)) + 1, F.when(F.col("event_id") % 8 == 0, 8000).otherwise(1600))
    p = posteriors_udf(spark, random_tagger(["<sil>", "a", "b"]), log_mel_udf(tone))
    run = spread(table(spark, sf_dir, "events").select("event_id", "value")).select(F.col("event_id").alias("utt"), F.explode(runs_udf(p, 3)).alias("run"))
    return run.where("run.confidence >= 0").groupBy("utt").agg(F.count("*").alias("runs"), F.sum("run.n").alias("frames"))


# the other queries register themselves in the same tables
from loomspark.plans import curation  # noqa: E402, F401
