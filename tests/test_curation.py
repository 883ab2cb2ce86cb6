"""Label policy, pair making, sources, checkpoints and the command line on small tables."""

from __future__ import annotations

import io as pyio
import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.functions import audio, tagger
from loomspark.operators import frames, pairs, runs, stats
from loomspark.session import ship
from loomspark.sources import io


def test_positions_must_match(spark):
    a = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y")], "shard string, i int, a string")
    b = spark.createDataFrame([("s", 1, 7), ("s", 0, 8)], "shard string, i int, b int")
    assert sorted(tuple(r) for r in frames.zip_by_position(a, b, "shard", "i").select("i", "a", "b").collect()) == [(0, "x", 8), (1, "y", 7)]
    with pytest.raises(Exception, match="in one table only"):
        frames.zip_by_position(a, b.where("i = 0"), "shard", "i").collect()


def test_low_scores_have_no_frames_and_no_chunks(spark):
    u = spark.createDataFrame([("a", 5, -1.0), ("b", 5, -3.0), ("c", 5, None)], "utt string, n_frames int, score double")
    track = u.select("utt", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")).select("utt", "t", F.lit(3).alias("label"), F.lit("unit").alias("kind"))
    f = frames.floored(track, u, "score", -2.0)
    c = frames.track_counters(f, frames.chunks(frames.above_floor(u, "score", -2.0), 4, 2)).first()
    assert (c.frames, c.labelled, c.utts, c.low_score_utts, c.chunks) == (5, 5, 1, 2, 2)
    assert {r.label for r in f.where("utt <> 'a'").collect()} == {frames.IGNORE}


def test_chunk_features_and_masks(spark):
    frame = spark.range(7).select(F.lit("a").alias("utt"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"), F.col("id").cast("int").alias("label"))
    c = spark.createDataFrame([("a", 0, 4), ("a", 5, 2)], "utt string, start long, valid_len long")
    got = {r.start: (list(r.features), list(r.labels)) for r in frames.chunk_features(c, frame, "x", 4, 1.0, 2.0).collect()}
    assert got == {0: ([-0.5, 0.0, 0.5, 1.0], [0, 1, 2, 3]), 5: ([2.0, 2.5, 0.0, 0.0], [5, 6, frames.IGNORE, frames.IGNORE])}
    m = F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))
    assert spark.range(1).select(frames.masked(F.array(*map(F.lit, [5, 6, 7, 8])), m, F.lit(-1)).alias("x")).first().x == [5, -1, -1, 8]


def test_tiles_give_what_one_pass_gives(spark, tmp_path):
    t = tagger.random_tagger(["<sil>", "a", "b"], dilations=(1, 2, 4))
    mel = np.random.default_rng(1).normal(size=(230, audio.N_MELS)).astype(np.float32)
    whole = t.posteriors(mel)
    for size in (1, 7, 64, 500):
        assert tagger.tiled_posteriors(t, mel, size) == pytest.approx(whole, abs=1e-5)
    tagger.save(t, str(tmp_path / "w.npz"))
    assert tagger.load(str(tmp_path / "w.npz")).posteriors(mel) == pytest.approx(whole, abs=1e-6)
    tiles = [tuple(r) for r in frames.tiles(spark.createDataFrame([("a", 10), ("b", 0)], "utt string, n_frames int"), 4, 3).collect()]
    assert tiles == [("a", 0, 7, 0, 4), ("a", 1, 10, 4, 8), ("a", 5, 10, 8, 10)]


def test_releasable_merges_and_refuses(spark):
    w = {"a": np.zeros((2, 3)), "b": np.zeros(2)}
    best = {"weights": w, "classes": ["x"], "optimizer": 1, "stale": 2}
    last = {"weights": {"a": np.ones((2, 3)), "b": np.ones(2)}, "epoch": 3, "history": [{"epoch": 2, "val_uer": 0.5}, {"epoch": 3, "val_uer": 0.4, "loss": 1}]}
    out = runs.releasable(best, last)
    assert out["weights"]["a"].all() and out["val"] == {"uer": 0.4} and "optimizer" not in out and out["classes"] == ["x"] and out["epoch"] == 3
    with pytest.raises(ValueError, match="a, b"):
        runs.releasable(best, {"weights": {"a": np.ones((9, 9)), "b": np.ones(9)}})
    with pytest.raises(ValueError, match="c"):
        runs.releasable(best, {"weights": w | {"c": np.ones(1)}})


def test_sources_resolve_and_cache(spark, tmp_path):
    rows = [("a b", "ab", "1"), ("", "x", "2"), ("c d", "cd", None)]
    df = spark.createDataFrame(rows, "units string, text string, id string")
    df.coalesce(1).write.parquet((tmp_path / "hub/org/pairs").as_uri())
    got, where = io.resolve_pairs(spark, None, "twi", (tmp_path / "hub").as_uri(), {"twi": "org/pairs"})
    assert where == "set org/pairs" and sorted(tuple(r) for r in got.select("units", "origin", "source").collect()) == [("a b", "real", ""), ("c d", "real", "")]
    with pytest.raises(FileNotFoundError):
        io.resolve_pairs(spark, "org/none", "twi", (tmp_path / "hub").as_uri())
    with pytest.raises(ValueError, match="no published"):
        io.resolve_pairs(spark, None, "ewe")
    built = []
    make = lambda: built.append(1) or df
    for _ in range(2):
        assert io.cached(spark, tmp_path.as_uri(), "key1", make).count() == 3
    assert built == [1]
    for k, n in (("b", 2), ("a", 1)):
        (tmp_path / "shards").mkdir(exist_ok=True)
        (tmp_path / f"shards/{k}.csv").write_text("units,text,source\n" + f"u,t,{k}\n" * n)
    pairs_, counts = io.finalise(spark, (tmp_path / "shards").as_uri())
    assert pairs_.count() == 3 and {r.source: r.n for r in counts.collect()} == {"a": 1, "b": 2}
    store = spark.createDataFrame([("tts", 0, 1.0), ("tts", 1, 2.0)], "split string, shard int, x double")
    for _ in range(2):
        io.write_features(store, (tmp_path / "store").as_uri())
    io.write_features(store.where("shard = 1"), (tmp_path / "store").as_uri())
    kept = spark.read.parquet((tmp_path / "store").as_uri())
    assert kept.count() == 2 and [r.shard for r in io.missing_shards(kept, spark.createDataFrame([("tts", 1), ("tts", 5)], "split string, shard int")).collect()] == [5]
    (tmp_path / "run").mkdir()
    (tmp_path / "run/best.npz").write_bytes(b"")
    assert io.resolve_checkpoint(spark, (tmp_path / "run").as_uri(), "twi").endswith("run/best.npz")
    with pytest.raises(FileNotFoundError):
        io.resolve_checkpoint(spark, None, "twi", {"twi": (tmp_path / "gone.npz").as_uri()})


def test_json_arrays_are_whole(spark, tmp_path):
    for n in (0, 1, 50):
        io.write_records(spark.range(n).repartition(3).select("id", F.lit("a,\n").alias("t")), (tmp_path / f"j{n}").as_uri(), "json")
        found = json.loads("".join(p.read_text() for p in sorted((tmp_path / f"j{n}").glob("part-*"))))
        assert sorted(r["id"] for r in found) == list(range(n)) and all(r["t"] == "a,\n" for r in found)


def test_csv_ids_follow_the_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('units,text,id\n"a ""b""",x,\n,y,\nc,"z\nz",own\nd,w,\n')
    got = [(r.units, r.id) for r in io.read_pairs(spark, (tmp_path / "p.csv").as_uri()).collect()]
    assert got == [('a "b"', "2"), ("c", "own"), ("d", "5")]


def test_numbering_without_one_task(spark):
    df = spark.range(50).select((F.col("id") * 37 % 1000).alias("k"), F.lit("u").alias("units"), F.when(F.col("id") != 7, "t").alias("text"))
    order = sorted(k * 37 % 1000 for k in range(50))
    assert {r.k: r.place for r in pairs.numbered(df, "k").collect()} == {k: n for n, k in enumerate(order)}
    assert pairs.numbered(df.limit(0), "k").count() == 0 and pairs.defaults(df, "k").count() == 49
    maker = spark.createDataFrame([(None, 0.0, 9, 0.1), (" ", 0.0, 9, 0.1), ("t", -3.0, 9, 0.1), ("t", 0.0, 4, 0.1), ("t", 0.0, 9, 0.7), ("t", 0.0, 9, 0.6)], "t string, s double, n int, u double")
    assert [r.r for r in maker.select(pairs.maker_gate(F.col("t"), F.col("s"), F.col("n"), F.col("u"), -2.0, 5, 0.6).alias("r")).collect()] == ["no_text", "no_text", "low_score", "short_reference", "uer", None]


def wav(samples, width=2, rate=audio.RATE, channels=1):
    out = pyio.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        top = 2 ** (8 * width - 1)
        for x in samples:
            v = round(x * (top - 1))
            w.writeframes(struct.pack("<i", v)[:width] if width > 1 else bytes([v + 128]))
    return out.getvalue()


def test_waves_of_all_widths_and_forms(spark):
    ship(spark)
    tone = [math.sin(k / 9) / 2 for k in range(400)]
    rows = [(None, wav(tone, w)) for w in (1, 2, 3, 4)] + [(tone, None), ([x * 32768 for x in tone], b"x"), (None, b"junk"), (None, None)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, a struct<array:array<double>, bytes:binary>").coalesce(1)
    got = {r.k: r.d for r in df.select("k", audio.waveform(F.col("a"), ["array", "bytes"]).alias("d")).collect()}
    for k in range(6):
        assert got[k].samples == pytest.approx(tone, abs=0.02 if k == 0 else 2e-4) and got[k].error is None
    assert got[6].samples is None and got[6].error and got[7].error


def test_command_line_over_audio(spark, tmp_path, capsys):
    tagger.save(tagger.random_tagger(["<sil>", "a", "b"]), str(tmp_path / "m.npz"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(wav([math.sin(k / 9) / 2 for k in range(8000)]))
    (tmp_path / "in/b.wav").write_bytes(b"junk")
    cli.main(["transcribe", str(tmp_path / "in"), "--model", str(tmp_path / "m.npz"), "-o", str(tmp_path / "t"), "--min-frames", "1", "--keep-silence"])
    got = {r.id[-5:]: r for r in spark.read.json(str(tmp_path / "t")).collect()}
    assert got["a.wav"].units and got["a.wav"].error is None and got["b.wav"].units == "" and got["b.wav"].error
    rows = [((wav([math.sin(k / (9 + i)) / 2 for k in range(4000)]), f"p{i}"), "aba" * i) for i in range(5)]
    spark.createDataFrame(rows, "audio struct<bytes:binary, path:string>, text string").coalesce(1).write.parquet(str(tmp_path / "tab"))
    cli.main(["table", str(tmp_path / "tab"), "--model", str(tmp_path / "m.npz"), "-o", str(tmp_path / "u"), "--score", "--offset", "1", "-n", "3"])
    out = sorted((r.id.rsplit(":", 1)[1], r.reference_units) for r in spark.read.json(str(tmp_path / "u")).collect())
    assert out == [("1", "a b a"), ("2", "a b a a b a"), ("3", "a b a a b a a b a")] and "3 rows scored" in capsys.readouterr().err
    spark.createDataFrame([("u", 0, 1), ("u", 1, 1), ("u", 2, 0), ("u", 3, -100)], "utt string, t int, label int").write.parquet(str(tmp_path / "track"))
    cli.main(["inspect", str(tmp_path / "track")])
    assert capsys.readouterr().out.split("\n")[:2] == ["1\t2\t66.67\t75.00", "0\t1\t33.33\t75.00"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.csv").write_text("units,text,source,id\n" + "".join(f"u,t,{k % 2 + 1},{k}\n" for k in range(20)))
    cli.main(["real-pairs", str(tmp_path / "c"), "-o", str(tmp_path / "pairs"), "--sample", "10"])
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 10


def test_reports(spark):
    rows = spark.createDataFrame([("s", 10.0, 100, -1.0, None), ("s", 5.0, 50, -9.0, "low"), ("z", 1.0, 1, 0.0, "short"), ("s", 2.0, 5, -8.0, "low")], "shard string, sec double, b long, sc double, why string")
    got = {r.shard: (r.utterances, r.hours, r.mb, r.mean_score, r.skipped) for r in stats.shard_summary(rows, "shard", "sec", "b", "sc", "why").collect()}
    assert got == {"s": (1, 10 / 3600, 1e-4, -1.0, {"low": 2}), "z": (0, 0.0, 0.0, None, {"short": 1})}
    assert json.loads(json.dumps({r.origin: r.n for r in stats.by_origin(spark.createDataFrame([("real",), ("other",)], "origin string")).collect()})) == {"real": 1, "clean-ref": 0, "clean-text": 0, "other": 1}
