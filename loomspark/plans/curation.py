"""Registered queries of pair making, label policy, reports and checkpoints, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import audio
from loomspark.functions.distance import cer
from loomspark.functions.text import TWI, missing_characters
from loomspark.operators import frames, pairs, runs, sampling, stats
from loomspark.plans.queries import _CHUNKS, _PREV, _SPANS, _TRACK, _UNITS, _spans, _track, _turn_pairs, query, spread, table

_LOW = "l AS (SELECT doc_id, coalesce(quality, 1) - 0.5 AS score FROM documents LEFT JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("n_frames"), (F.coalesce("quality", F.lit(1)) - 0.5).alias("score"))


@query(f"WITH {_LOW}, d AS (SELECT documents.* FROM documents JOIN l USING (doc_id) WHERE score >= 0) {_CHUNKS.format(i='doc_id', n='n_chars', c=300, s=200, f='d')}")
def floor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of utterances that reach the score floor; those below it have none."""
    return frames.chunks(frames.above_floor(_scored(spark, sf_dir), "score", 0.0), 300, 200)


@query(f"""WITH {_TRACK}, low AS (SELECT DISTINCT utt FROM s WHERE utt % 3 = 0), c AS (SELECT count(*) AS chunks FROM (SELECT DISTINCT utt FROM s WHERE utt % 3 <> 0), range(0, 13))
SELECT count(*) FILTER (kind = 'silence' AND utt % 3 <> 0) AS silence, count(*) FILTER (kind = 'short_gap' AND utt % 3 <> 0) AS short_gap, count(*) FILTER (kind = 'loud_gap' AND utt % 3 <> 0) AS loud_gap, count(*) FILTER (label >= 0 AND utt % 3 <> 0) AS labelled, count(*) FILTER (utt % 3 <> 0) AS frames,
count(DISTINCT utt) FILTER (utt % 3 <> 0) AS utts, (SELECT count(*) FROM low) AS low_score_utts, (SELECT chunks FROM c) AS chunks FROM track""")
def track_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt")).distinct().select("utt", F.lit(724).cast("long").alias("n_frames"), F.when(F.col("utt") % 3 == 0, -3.0).otherwise(-1.0).alias("score"))
    track = frames.floored(_track(spark, sf_dir), u, "score", -2.0)
    return frames.track_counters(track, frames.chunks(frames.above_floor(u, "score", -2.0), 100, 52))


@query(f"WITH {_TRACK}, c AS (SELECT utt, unnest(list_distinct(list_append(generate_series(0, 624, 100), 624))) AS start FROM (SELECT DISTINCT utt FROM s)), n AS (SELECT label, count(*) AS n FROM c JOIN track ON track.utt = c.utt AND t >= start AND t < start + 100 WHERE label >= 0 GROUP BY 1) SELECT v.class::INTEGER AS class, coalesce(n, 0)::BIGINT AS n FROM range(0, 7) v(class) LEFT JOIN n ON n.label = v.class")
def frame_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.chunks(table(spark, sf_dir, "events").select(F.col("user_id").alias("utt")).distinct().withColumn("n_frames", F.lit(724).cast("long")), 100, 100)
    return frames.class_counts(c, _track(spark, sf_dir), spark.range(7).select(F.col("id").cast("int").alias("class")))


@query(f"WITH {_TRACK}, n AS (SELECT label, count(*) AS n FROM track GROUP BY 1) SELECT label::INTEGER AS label, n, round(100.0 * n / sum(n) FILTER (label >= 0) OVER (), 9) AS pct, round((SELECT 100.0 * sum(n) FILTER (label >= 0) / sum(n) FROM n), 9) AS labelled_pct FROM n QUALIFY label >= 0")
def inspect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = stats.inspect(_track(spark, sf_dir))
    return i.select(F.col("label").cast("int").alias("label"), "n", F.round("pct", 9).alias("pct"), F.round("labelled_pct", 9).alias("labelled_pct"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN coalesce(quality, 1) - 2.5 < -2 THEN 'low_score' WHEN n_chars // 100 < 5 THEN 'short_reference' WHEN (n_chars % 100) / 100 > 0.6 THEN 'uer' ELSE 'kept' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason""")
def maker_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    gate = pairs.maker_gate(F.col("text"), F.coalesce("quality", F.lit(1)) - 2.5, F.floor(F.col("n_chars") / 100), (F.col("n_chars") % 100) / 100, -2.0, 5, 0.6)
    return stats.skip_counts(j.select(F.coalesce(gate, F.lit("kept")).alias("reason")), "reason")


@query("WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, doc_id, n_chars FROM documents) SELECT source, place, doc_id, n_chars FROM d")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    d = table(spark, sf_dir, "documents").select("source", at.alias("place"), "doc_id", "n_chars")
    return frames.zip_by_position(d.select("source", "place", "doc_id"), d.select("source", "place", "n_chars"), "source", "place")


@query("SELECT s.event_id, greatest(0, least(round_even(coalesce(value, 0), 0)::BIGINT, n - 1))::BIGINT AS start, greatest(greatest(0, least(round_even(coalesce(value, 0), 0)::BIGINT, n - 1)) + 1, least(round_even(coalesce(value, 0) + 2.5, 0)::BIGINT, n))::BIGINT AS end FROM (SELECT *, 20 + user_id % 40 AS n FROM events) s")
def clamped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.coalesce("value", F.lit(0.0))
    e = table(spark, sf_dir, "events").select("event_id", frames.clamp_span(v, v + 2.5, (20 + F.col("user_id") % 40).cast("long"), 1).alias("s"))
    return e.select("event_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("""WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '<star>' ELSE 'u' || label END AS token, vec_id % 10 AS first, vec_id % 10 + label AS last, embedding::DOUBLE[] AS s FROM embeddings)
SELECT vec_id, token, round(first * 0.02, 9) AS start_s, round(last * 0.02, 9) AS end_s, round(CASE WHEN last > first THEN list_avg(s[first + 1:last]) ELSE 0 END, 9) AS score FROM t WHERE token <> '<star>'""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("vec_id") % 10).cast("int")
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, "<star>").otherwise(F.concat(F.lit("u"), "label")).alias("token"), first.alias("first"), (first + F.col("label")).alias("last"), F.col("embedding").cast("array<double>").alias("scores"))
    r = frames.token_spans(t, 0.02)
    return r.select("vec_id", "token", *[F.round(c, 9).alias(c) for c in ("start_s", "end_s", "score")])


@query("""WITH t AS (SELECT doc_id AS utt, n_chars AS n, unnest(generate_series(0::BIGINT, n_chars - 1, 500::BIGINT)) AS k FROM documents WHERE n_chars > 0)
SELECT utt, greatest(k - 37, 0)::BIGINT AS "from", least(least(k + 500, n) + 37, n)::BIGINT AS "to", k AS keep_from, least(k + 500, n)::BIGINT AS keep_to FROM t""")
def posterior_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.tiles(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("n_frames")), 500, 37)


@query("""WITH u AS (SELECT doc_id, n_chars AS n, ('0x' || substr(md5('5:0:' || doc_id), 1, 8))::BIGINT AS a, ('0x' || substr(md5('5:1:' || doc_id), 1, 8))::BIGINT AS b FROM documents), m AS (SELECT *, least(a % 41, n) AS size FROM u)
SELECT doc_id, (b % (n - size + 1))::BIGINT AS start, (b % (n - size + 1) + size)::BIGINT AS "end", (n - size)::BIGINT AS kept FROM m""")
def time_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n")).withColumn("m", frames.time_mask(F.col("doc_id"), F.col("n"), 40, 5))
    labels = frames.masked(F.array_repeat(F.lit(1), F.col("n").cast("int")), F.col("m"), F.lit(frames.IGNORE))
    return d.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.size(F.filter(labels, lambda x: x >= 0)).cast("long").alias("kept"))


@query("SELECT p_partkey, (p_size * 7) // 10 AS chunk, greatest((p_size * 7 // 5) // 10, 1) AS stride FROM part")
def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", frames.ms_to_frames(F.col("p_size") * 7).alias("chunk"), frames.ms_to_frames(F.floor(F.col("p_size") * 7 / 5), least=1).alias("stride"))


@query(f"WITH {_SPANS}, v AS (SELECT unit FROM u GROUP BY unit HAVING count(*) >= (SELECT count(*) / 5 FROM u)) SELECT unit, count(*) AS n, sum(e - s)::BIGINT AS frames FROM u WHERE unit IN (SELECT unit FROM v) GROUP BY unit")
def units_in_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _spans(spark, sf_dir)
    vocab = u.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(u.count() / 5))
    return stats.in_vocabulary(u, vocab).groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("frames"))


@query(f"WITH {_SPANS}, v AS (SELECT unit FROM u GROUP BY unit HAVING count(*) >= (SELECT count(*) / 5 FROM u)) SELECT unit, count(*) AS occurrences FROM u WHERE unit NOT IN (SELECT unit FROM v) GROUP BY unit")
def dropped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _spans(spark, sf_dir)
    vocab = u.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(u.count() / 5))
    return stats.dropped_units(u, vocab)


@query(f"WITH {_SPANS} SELECT unit, count(*) AS n, round(avg(e - s), 6) AS mean, round(median((e - s)::DOUBLE), 6) AS median, round(avg(value), 6) AS mean_score, round(median(value), 6) AS median_score, round(100 * avg(CASE WHEN value < 10 THEN 1.0 WHEN value >= 10 THEN 0.0 END), 6) AS dropped_pct FROM u GROUP BY unit HAVING count(*) >= 20")
def unit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _spans(spark, sf_dir).select("unit", (F.col("end") - F.col("start")).cast("double").alias("d"), "value")
    r = stats.unit_report(u, "unit", "d", "value", 10.0)
    return r.select("unit", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "mean_score", "median_score", "dropped_pct")])


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 3")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common(table(spark, sf_dir, "lineitem"), "l_partkey", 3)


@query(f"WITH {_PREV}, z AS (SELECT conv_id, count(*) AS pairs, sum(ref_len) AS refs, sum(edits) / greatest(sum(ref_len), 1) AS uer FROM e GROUP BY conv_id) SELECT sum(pairs)::BIGINT AS pairs, sum(refs)::BIGINT AS refs, round(sum(uer * refs) / greatest(sum(refs), 1), 9) AS uer FROM z")
def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _turn_pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum("ref_len").alias("refs"), (F.sum("edits") / F.greatest(F.sum("ref_len"), F.lit(1))).alias("uer"))
    return stats.pair_totals(parts).withColumn("uer", F.round("uer", 9))


@query("SELECT o.origin, count(doc_id) AS n FROM (VALUES ('real'), ('clean-ref'), ('clean-text')) o(origin) LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN 'clean-ref' ELSE 'real' END AS origin FROM documents) d USING (origin) GROUP BY 1")
def mix_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_origin(table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "de", "clean-ref").otherwise("real").alias("origin")))


@query("""WITH d AS (SELECT source, n_chars, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars > 4000 THEN 'long' END AS reason FROM documents), r AS (SELECT source, reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1, 2), m AS (SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS skipped FROM r GROUP BY 1),
b AS (SELECT source, count(*) FILTER (reason IS NULL) AS utterances, round(coalesce(sum(n_chars) FILTER (reason IS NULL), 0) / 3600.0, 9) AS hours, round(coalesce(sum(n_chars) FILTER (reason IS NULL), 0) / 1e6, 9) AS mb, round(avg(n_chars) FILTER (reason IS NULL), 6) AS mean_score FROM d GROUP BY 1)
SELECT b.*, coalesce(skipped, '') AS skipped FROM b LEFT JOIN m USING (source)""")
def shard_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") > 4000, "long")
    s = stats.shard_summary(table(spark, sf_dir, "documents").select("source", "n_chars", reason.alias("reason")), "source", "n_chars", "n_chars", "n_chars", "reason")
    text = F.array_join(F.transform(F.map_entries("skipped"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return s.select("source", "utterances", F.round("hours", 9).alias("hours"), F.round("mb", 9).alias("mb"), F.round("mean_score", 6).alias("mean_score"), text.alias("skipped"))


@query("WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents) SELECT doc_id, format('{}_{:05d}_{}', source, r // 100, r % 100) AS utt, r + 7 AS index, format('clean{:07d}', r) AS id FROM d")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", r.alias("r"))
    return d.select("doc_id", F.format_string("%s_%05d_%d", "source", F.floor(F.col("r") / 100), F.col("r") % 100).alias("utt"), (F.col("r") + 7).alias("index"), F.format_string("clean%07d", "r").alias("id"))


@query("WITH d AS (SELECT doc_id, lang AS units, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS text, CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END AS id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) SELECT units, text, 'real' AS origin, '' AS source, coalesce(id, (place + 3)::VARCHAR) AS id FROM d WHERE text <> ''")
def default_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("units"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), "doc_id")).alias("id"))
    return pairs.defaults(d, "doc_id", 3).select("units", "text", "origin", "source", "id")


@query("WITH p AS (SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM conversations), o AS (SELECT item_id, text FROM benchmark) SELECT split, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT split, text AS t FROM p WHERE split <> 'test' UNION ALL SELECT 'test', text FROM o) GROUP BY split")
def replaced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("conv_id") % 3
    p = table(spark, sf_dir, "conversations").select(F.col("role").alias("source_text"), F.col("text").alias("target_text"), F.when(m == 0, "test").when(m == 1, "val").otherwise("train").alias("split"))
    o = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("units"), "text")
    r = pairs.replace_split(p, o)
    return r.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("target_text")).alias("chars"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 40")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), ["o_orderdate", "o_orderkey"], 40, 25).select("o_orderkey", "o_totalprice")


@query(f"WITH u AS (SELECT doc_id, {_UNITS} AS u FROM documents) SELECT doc_id, len(list_filter(u, lambda x: length(x) = 1))::INTEGER AS refs FROM u WHERE len(list_filter(u, lambda x: length(x) = 1)) >= 200 ORDER BY doc_id LIMIT 20")
def dev_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts that have enough units of a vocabulary (here: the single letters)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.filter(TWI.units(F.col("text")), lambda u: F.length(u) == 1).alias("refs"))
    return sampling.first_kept(d, F.size("refs") >= 200, ["doc_id"], 20).select("doc_id", F.size("refs").alias("refs"))


@query(f"WITH u AS (SELECT doc_id, {_UNITS} AS u FROM documents), k AS (SELECT doc_id, u, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM u WHERE len(u) BETWEEN 50 AND 2000) SELECT format('clean{{:07d}}', r) AS id, md5(array_to_string(u, '')) AS source_md5, 'clean-text' AS origin FROM k WHERE r < 30")
def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", TWI.units(F.col("text")).alias("u"))
    kept = sampling.first_kept(d, F.size("u").between(50, 2000), ["doc_id"], 30)
    r = F.row_number().over(Window.orderBy("doc_id")) - 1  # of the 30 rows that are left
    return kept.select(F.format_string("clean%07d", r).alias("id"), F.md5(F.array_join("u", "").cast("binary")).alias("source_md5"), F.lit("clean-text").alias("origin"))


@query("""WITH n AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT g, round_even(40 * n::DOUBLE / sum(n) OVER (), 0) AS q FROM n), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('6:' || doc_id), doc_id) AS r FROM p WHERE p <= 160) SELECT doc_id, source FROM r JOIN q ON q.g = r.source WHERE r <= q""")
def published_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_published(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", 40, "n_chars", 6).select("doc_id", "source")


@query("WITH c AS (SELECT event_id FROM events) SELECT event_id FROM c ORDER BY md5('9:' || event_id), event_id LIMIT 300")
def norm_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_by_hash(table(spark, sf_dir, "events").select("event_id"), "event_id", 300, None, 9)


@query("WITH r AS (SELECT p_partkey AS split, p_size % 5 AS shards, p_size * 10 AS target FROM part) SELECT split, unnest(range(0, shards::BIGINT)) AS shard, shards::BIGINT AS shards, ceil(target / shards)::BIGINT AS cap FROM r WHERE shards > 0")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("split"), (F.col("p_size") % 5).alias("shards"), (F.col("p_size") * 10).alias("target"))
    return sampling.jobs(r)


@query("SELECT conv_id, turn, left(text, 80) AS text FROM conversations ORDER BY conv_id, turn LIMIT 5")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.samples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 18")
def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 18)


@query("SELECT event_type, user_id % 3 AS width, count(*) AS n, round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM events GROUP BY 1, 2")
def grid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = runs.grid_means(table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("width"), "value", "event_id"), ["event_type", "width"], "value", "event_id")
    return g.select("event_type", "width", "n", F.round("value", 6).alias("value"), F.round("event_id", 6).alias("event_id"))


@query("""WITH k AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0)) AS a, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 1)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))[1:3], ',') AS missing, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)))[1:3], ',') AS unexpected FROM k""")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda k: F.collect_set(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderpriority")))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(own(0).alias("a"), own(1).alias("b")).withColumn("d", runs.key_diff(F.col("a"), F.col("b")))
    return g.select("o_custkey", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.unexpected", ",").alias("unexpected"))


@query("SELECT c_custkey, 'name=' || c_name || ',segment=' || c_mktsegment AS metrics, 'val_name,val_segment' AS kept FROM customer")
def metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("val_segment"), "c_mktsegment", F.lit("optimizer"), F.col("c_custkey").cast("string"), F.lit("val_name"), "c_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", runs.unprefixed(m, "val_").alias("v"), runs.without(m, ["optimizer"]).alias("w"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("v")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return c.select("c_custkey", listed.alias("metrics"), F.array_join(F.array_sort(F.map_keys("w")), ",").alias("kept"))


@query("WITH w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN label % 2 = 1 THEN 30000 ELSE 1 END) AS x FROM embeddings), s AS (SELECT vec_id, CASE WHEN list_max(list_transform(x, lambda v: abs(v))) > 1.5 THEN list_transform(x, lambda v: v / 32768.0) ELSE x END AS x FROM w) SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 9) AS energy FROM s")
def scaled_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("label") % 2 == 1, 30000.0).otherwise(1.0)
    e = table(spark, sf_dir, "embeddings").select("vec_id", audio.scaled(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * by)).alias("x"))
    return e.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 9).alias("energy"))


@query("WITH k AS (SELECT DISTINCT unnest(string_split(lower(n_name), '')) AS c FROM nation), n AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS character) SELECT character FROM n WHERE character NOT IN (SELECT c FROM k)")
def missing_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "nation").select(F.explode(F.split(F.lower("n_name"), "")).alias("character")).distinct()
    return missing_characters(TWI, k)


_CHAR = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr((32 + list_position(d, c))::INTEGER)), '')"


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS hyp, b.t AS ref, list_distinct(string_split(a.t || b.t, '')) AS d FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, round(CASE WHEN ref = '' THEN CASE WHEN hyp <> '' THEN 1.0 ELSE 0.0 END WHEN hyp = '' THEN 1.0 ELSE levenshtein({_CHAR.format('hyp')}, {_CHAR.format('ref')}) / length(ref) END, 9) AS cer FROM p""")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER of neighbouring turns."""
    t = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ref")))
    p = spread(t.select("conv_id", (F.col("turn") + 1).alias("turn"), "ref").join(t.withColumnRenamed("ref", "hyp"), ["conv_id", "turn"]))
    return p.select("conv_id", "turn", F.round(cer(F.col("hyp"), F.col("ref")), 9).alias("cer"))
