from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import decode, frames, metrics, pairs, sampling, stats
from loomspark.sources import io
from loomspark.streaming.incremental import process_new


def test_label_track(spark):
    spans = spark.createDataFrame([("u", 0, 1, 0, 10), ("u", 1, 3, 20, 40), ("u", 2, 2, 40, 60)], "utt string, k int, label int, start int, end int")
    t = spark.range(60).select(F.lit("u").alias("utt"), F.col("id").cast("int").alias("t"), F.when(F.col("id").between(10, 19), -8.0).otherwise(5.0).alias("energy"))
    for gap, want in ((10, 0), (20, -100)):
        got = [r.label for r in frames.label_track(t, frames.paint(spans), gap).orderBy("t").collect()]
        assert got == [1] * 10 + [want] * 10 + [3] * 20 + [2] * 20


@pytest.mark.parametrize("energy,percentile,label", [(-8.0, 10, 0), (5.0, 10, -100), (5.0, 100, 0)])
def test_loud_gap(spark, energy, percentile, label):
    spans = spark.createDataFrame([("u", 0, 1, 0, 30), ("u", 1, 2, 70, 100)], "utt string, k int, label int, start int, end int")
    t = spark.range(100).select(F.lit("u").alias("utt"), F.col("id").cast("int").alias("t"), F.when(F.col("id").between(30, 69), F.lit(energy)).otherwise(5.0).alias("energy"))
    assert {r.label for r in frames.label_track(t, frames.paint(spans), 10, percentile).where("t between 30 and 69").collect()} == {label}


def test_overlap_and_chunks(spark):
    spans = spark.createDataFrame([("u", 0, 1, 0, 5), ("u", 1, 2, 4, 8)], "utt string, k int, label int, start int, end int")
    assert [r.label for r in frames.paint(spans).orderBy("t").collect()] == [1] * 4 + [2] * 4
    u = spark.createDataFrame([("a", 60), ("b", 7), ("c", 65)], "utt string, n_frames long")
    got = {(r.utt, r.start, r.valid_len) for r in frames.chunks(u, 20, 10).collect()}
    assert got == {("a", s, 20) for s in (0, 10, 20, 30, 40)} | {("b", 0, 7)} | {("c", s, 20) for s in (0, 10, 20, 30, 40, 45)}


def posteriors(spark, runs):
    seq = [c for c, n in runs for _ in range(n)]
    return spark.createDataFrame([("u", t, k, 0.9 if k == c else 0.05) for t, c in enumerate(seq) for k in range(3)], "utt string, t int, class int, p double")


@pytest.mark.parametrize("runs,split,want", [([(1, 6)], True, [1]), ([(1, 12)], True, [1, 1]), ([(1, 12)], False, [1]), ([(1, 8)], True, [1]), ([(1, 200)], True, [1] * 3), ([(1, 15), (2, 15)], False, [1, 2])])
def test_decoding(spark, runs, split, want):
    med = spark.createDataFrame([(0, 0.0), (1, 6.0), (2, 6.0)], "class int, median_frames double")
    r = decode.runs(decode.argmax(posteriors(spark, runs)), drop_class=0)
    r = decode.split_long(r, med) if split else r.withColumn("start_s", F.col("start") * 0.01)
    assert [x["class"] for x in r.orderBy("start_s").collect()] == want


def test_smoothing_edges(spark):
    df = spark.createDataFrame([("u", t, 0, float(t * t)) for t in range(10)], "utt string, t int, class int, p double")
    for w in (4, 7):
        p = [float(t * t) for t in range(10)]
        pad = [p[0]] * (w // 2) + p + [p[-1]] * (w - 1 - w // 2)
        want = [sum(pad[t : t + w]) / w for t in range(10)]
        assert [r.p for r in decode.smooth(df, w).orderBy("t").collect()] == pytest.approx(want)


def test_collapse_and_early_stop(spark):
    df = spark.createDataFrame([([1, 1, 1, 0, 0, 2, 2, 3],), ([1, 1, 2, 2, 1, 1],), ([0, 0, 0],)], "s array<int>")
    assert [r[0] for r in df.select(decode.collapse(F.col("s"))).collect()] == [[1, 2, 3], [1, 2, 1], []]
    h = spark.createDataFrame(list(enumerate([0.60, 0.66, 0.68, 0.6803, 0.679, 0.6804, 0.70])), "i int, m double")
    assert tuple(decode.early_stop(h, "i", "m", 5e-4, 3).first()) == (0.68, 5)


def test_mix(spark):
    real = spark.range(100).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("s").alias("source"))
    for n, ratio, used in ((40, 1, 40), (500, 1, 100), (40, 0, 0), (40, 0.5, 20), (40, 2, 80)):
        syn = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit("syn").alias("source"))
        rows, report = sampling.mix(syn, real, "source", "id", ratio)
        assert rows.count() == n + used == report.first().total and rows.select("id").distinct().count() == n + used
    with pytest.raises(ValueError):
        sampling.mix(real, real, "source", "id", -1)


def test_quotas(spark):
    pool = spark.range(10000).select("id", F.when(F.col("id") < 7500, "kuma").when(F.col("id") < 9500, "asr").otherwise("tts").alias("source"))
    n = lambda b: {r.source: r["count"] for r in sampling.stratified_sample(pool, "source", "id", 3000, b).groupBy("source").count().collect()}
    assert n("proportional") == {"kuma": 2250, "asr": 600, "tts": 150}
    e = n("equal")
    assert e["tts"] == 500 and sum(e.values()) == 3000 and e["kuma"] / e["asr"] < 2
    with pytest.raises(ValueError):
        sampling.quotas(pool, "source", 5, "other")


def test_gates_and_layout(spark):
    df = spark.createDataFrame([(" ", 5.0, 50), ("x", None, 50), ("x", 0.1, 50), ("x", 5.0, 2), ("x", 5.0, 500), ("x", 5.0, 50)], "t string, s double, n int")
    assert [r[0] for r in df.select(pairs.utterance_gate(F.col("t"), F.col("s"), F.col("n"))).collect()] == ["empty_text", "decode_error", "duration", "few_units", "rate", None]
    u = spark.createDataFrame([("a b c", "a b c"), ("a b c", "a b"), ("", "a b c d"), ("a b", ""), ("a", None)], "units string, reference_units string")
    assert [r.uer for r in pairs.with_uer(u).collect()] == [0.0, 0.5, 1.0, 1.0, None]
    x = spark.createDataFrame([([1, 2, 3], [7])], "s array<int>, t array<int>").select(pairs.build_example(F.col("s"), F.col("t"), F.array(F.lit(5)), F.array(F.lit(6)), 2, 99).alias("e")).first().e
    assert x.input_ids == [5, 1, 2, 6, 7, 99] and x.labels == [-100] * 4 + [7, 99]
    with pytest.raises(Exception, match="next free id is 8"):
        pairs.source_id(spark.createDataFrame([("zz",)], "s string"), "s").collect()
    assert spark.createDataFrame([("a Twi text: ok \n",)], "d string").select(pairs.strip_prompt(F.col("d"))).first()[0] == "ok"


def test_vocab_and_metrics(spark):
    u = spark.createDataFrame([("ky", 0, 10), ("ɛ", 20, 40), ("m", 40, 60)] * 5, "unit string, start int, end int")
    assert [(r["class"], r.unit, r.frames) for r in stats.vocabulary(u, 1).orderBy("class").collect()] == [(0, "<sil>", 0), (1, "ky", 50), (2, "m", 100), (3, "ɛ", 100)]
    assert stats.vocabulary(u, 1000).count() == 1
    c = metrics.class_report(spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2)], "ref string, pred string, n long"))
    assert {r["class"]: (r.support, r.recall) for r in c.collect()} == {"a": (4, 0.75), "b": (2, 1.0)}


def test_pair_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "ab", "real", "1", "x", None), ("c", "c, \"d\"", "synthetic", "2", "y", "c")], io.PAIR)
    io.write_pairs(rows, str(tmp_path / "p.jsonl"))
    lines = [json.loads(x) for f in (tmp_path / "p.jsonl").glob("part*") for x in f.read_text().splitlines()]
    assert sorted("reference_units" in x for x in lines) == [False, True]
    assert io.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 2
    io.write_pairs_csv(rows, str(tmp_path / "p.csv"))
    assert {r.text for r in io.read_pairs(spark, str(tmp_path / "p.csv")).collect()} == {"ab", 'c, "d"'}
    (tmp_path / "bad.jsonl").write_text('{"units": "a"}\n')
    with pytest.raises(Exception, match="without units or text"):
        io.read_pairs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_columns(spark):
    df = spark.createDataFrame([("a", "b")], "speech string, twi_text string")
    assert io.find_column(df, "audio") == "speech" and io.find_column(df, "text") == "twi_text"
    with pytest.raises(ValueError):
        io.find_column(spark.createDataFrame([("a",)], "label string"), "audio")


def test_incremental(spark, tmp_path):
    schema = spark.range(1).schema
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        process_new(spark, str(tmp_path / "in"), schema, lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


@pytest.mark.parametrize("most", [0, 10_000])
def test_draws_in_hash_order_without_sorting_a_group(spark, monkeypatch, most):
    """Quotas of a group that holds most rows, of one that is too small, ties of ids, and of none."""
    monkeypatch.setattr(sampling, "MOST_GROUPS", most)
    df = spark.range(3000).select((F.col("id") % 2990).alias("k"), F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, "b").alias("g"), F.lit(1).alias("_row"))
    quota = spark.createDataFrame([("hot", 700), ("b", 490), ("?", 3)], "s string, q long")
    got = sampling.first_by_hash(df, "k", quota, "g", 4)
    assert got.columns == df.columns
    md5 = lambda k: hashlib.md5(f"4:{k}".encode()).hexdigest()
    want = sorted(range(2500), key=lambda k: (md5(k), k))[:700]
    assert sorted(r.k for r in got.where("g = 'hot'").collect()) == sorted(want) and got.where("g = 'b'").count() == 490 and got.where("g is null").count() == 3
    first, rest = sampling.split_by_hash(df, "k", quota, "g", 4)
    assert first.count() == 700 + 490 + 3 and rest.count() == 3000 - first.count() and not first.join(rest, "k").where("k >= 10 and k < 2500").count()
    assert sampling.first_by_hash(df, "k", 0).count() == 0 and sampling.first_by_hash(df, "k", 9999).count() == 3000 and sampling.first_by_hash(df.limit(0), "k", 5).count() == 0


def test_places_over_many_cells(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k: r.place for r in sampling.places(df, "k", 2, each=20).collect()}
    assert got == {k: n for n, k in enumerate(sorted(range(500), key=lambda k: hashlib.md5(f"2:{k}".encode()).hexdigest()), 1)}


def test_length_batches_by_a_plain_loop(spark):
    rng = random.Random(3)
    table = [(k, rng.choice("ab"), rng.choice((0, 1, 5, 5, 5, 7, 40, 90, 200))) for k in range(400)]
    want = {}
    for g in "ab":
        b = c = 0
        for n, k in sorted((n, k) for k, x, n in table if x == g):
            if c and n * (c + 1) > 100:
                b, c = b + 1, 0
            want[k], c = b, c + 1
    got = sampling.length_batches(spark.createDataFrame(table, "k long, g string, n int"), "g", "n", "k", 100)
    assert {r.k: r._batch for r in got.collect()} == want
