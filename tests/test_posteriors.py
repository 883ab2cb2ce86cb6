"""The tagger on whole batches: utterances of one length together, runs without a row for each frame and class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.functions import audio, tagger
from loomspark.operators import decode
from loomspark.plans.queries import QUERIES
from loomspark.session import ship
from tests.conftest import SF

ROWS = "utt int, p array<array<float>>"


def test_utterances_beside_each_other_have_their_own_figures():
    t = tagger.random_tagger(["<sil>", "a", "b"])
    waves = np.random.default_rng(1).normal(size=(40, 1600)).astype(np.float32)
    mels = audio.log_mel(waves)
    assert (mels == np.stack([audio.log_mel(x) for x in waves])).all()
    p = t.posteriors(mels)
    assert p.shape == (40, 11, 3) and (p == np.stack([t.posteriors(x) for x in mels])).all() and (p[5:9] == t.posteriors(mels[5:9])).all()
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(3, 2, 5, 7)), rng.normal(size=(4, 2, 3, 3))
    assert np.allclose(tagger.conv_plane(x, (w, np.ones(4))), np.stack([tagger.conv_plane(y, (w, np.ones(4))) for y in x]))
    assert tagger.halve_mels(np.arange(10.0).reshape(2, 1, 5, 1)).ravel().tolist() == [1, 3, 4, 6, 8, 9]


def test_alike_takes_each_place_once():
    sizes = np.array([3, 0, 3, 5, 3, 9, 5, 0, 1])
    got = list(audio.alike(sizes, 6))
    assert sorted(int(k) for same in got for k in same) == [0, 2, 3, 4, 5, 6, 8]
    assert all(len(set(sizes[same])) == 1 and (len(same) == 1 or sizes[same].sum() <= 6) for same in got)
    assert list(audio.alike(np.zeros(2, int), 6)) == [] and list(audio.alike(np.zeros(0, int), 6)) == []


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7])
def test_runs_of_arrays_are_those_of_rows(spark, width):
    ship(spark)
    rng = np.random.default_rng(width)
    # quarters: ties between classes, and runs
    rows = [(u, (rng.integers(0, 5, (n, 3)) / 4).tolist()) for u, n in enumerate([1, 2, 3, 40, 17, 40, 5])] + [(90, None), (91, [])]
    none = [None, None, None]
    rows += [(92, [[0.1, 0.5, 0.2], [None, 0.5, 0.1], [0.1, None, None], none, none, none, none, [0.2, 0.3, 0.1]]), (93, [none, [0.5, 0.1, 0.2], none]), (94, [none] * 3)]
    df = spark.createDataFrame(rows, ROWS).coalesce(2)
    want = decode.runs(decode.argmax(decode.smooth(tagger.long_posteriors(df, "p"), width)))
    got = df.select("utt", F.explode(tagger.runs_udf(F.col("p"), width)).alias("r")).select("utt", "r.*").where("confidence >= 0")
    order = lambda d: sorted(repr((r.utt, r["class"], r.start, r.n, round(r.confidence, 12))) for r in d.collect())
    assert order(got) == order(want) and len(order(got)) > 20
    empty = df.where("utt in (90, 91)").coalesce(1).select(tagger.runs_udf(F.col("p"), width).alias("r")).collect()
    assert [r.r for r in empty] == [None, None]


def test_batches_without_a_frame(spark):
    ship(spark)
    t = tagger.random_tagger(["<sil>", "a", "b"])
    df = spark.createDataFrame([(1, None), (2, [])], "utt int, x array<float>").coalesce(1)
    got = df.select("utt", tagger.posteriors_udf(spark, t, audio.log_mel_udf(F.col("x"))).alias("p")).collect()
    assert [r.p for r in got] == [None, None]
    nan = spark.createDataFrame([([float("nan")] * 1600,)], "x array<float>").select(audio.log_mel_udf(F.col("x")).alias("m")).first().m
    assert len(nan) == 11 and {x for frame in nan for x in frame} == {None}
    sliced = pa.array([[9.0], None, [0.0] * 400, [0.5] * 500, []], pa.list_(pa.float32())).slice(1)
    assert [None if m is None else len(m) for m in audio._log_mels(sliced).to_pylist()] == [None, 3, 4, None]


def test_query_is_what_its_steps_give_and_moves_no_frames(spark):
    got = QUERIES["posteriors"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 1 and "transform(" not in plan
    length = F.when(F.col("event_id") % 8 == 0, 8000).otherwise(1600)
    tone = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.sin(i * (F.coalesce("value", F.lit(0.0)) + 1) / 500).cast("float"))
    p = tagger.posteriors_udf(spark, tagger.random_tagger(["<sil>", "a", "b"]), audio.log_mel_udf(tone))
    long = tagger.long_posteriors(spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("utt"), p.alias("p")), "p")
    want = decode.runs(decode.argmax(decode.smooth(long, 3))).groupBy("utt").agg(F.count("*").alias("runs"), F.sum("n").alias("frames"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) == 1000 and {r[2] for r in rows} == {11, 51}
