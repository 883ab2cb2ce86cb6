from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.functions import tagger
from loomspark.functions.audio import N_MELS
from loomspark.operators import runs
from loomspark.session import ship
from loomspark.sources import io


def test_convolutions_match_loops():
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(2, 5, 7)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    got = tagger.conv_plane(x, (w, b))
    for o, f, t in np.ndindex(got.shape):
        want = b[o] + sum(w[o, c, i, j] * x[c, f + i - 1, t + j - 1] for c in range(2) for i in range(3) for j in range(3) if 0 <= f + i - 1 < 5 and 0 <= t + j - 1 < 7)
        assert got[o, f, t] == pytest.approx(want)
    y, v = rng.normal(size=(2, 9)), rng.normal(size=(4, 2, 3))
    got = tagger.conv_time(y, (v, np.ones(4)), 2)
    for o, t in np.ndindex(got.shape):
        assert got[o, t] == pytest.approx(1 + sum(v[o, c, k] * y[c, t + 2 * (k - 1)] for c in range(2) for k in range(3) if 0 <= t + 2 * (k - 1) < 9))
    assert tagger.halve_mels(np.arange(5.0).reshape(1, 5, 1)).ravel().tolist() == [1, 3, 4]
    gain, shift, mean, var = rng.random((4, 3))
    folded = tagger.fold_norm(w, gain, shift, mean, var)
    plain = tagger.conv_plane(x, (w, np.zeros(3)))
    assert np.allclose(tagger.conv_plane(x, folded), (plain - mean[:, None, None]) / np.sqrt(var + 1e-5)[:, None, None] * gain[:, None, None] + shift[:, None, None])


def test_tagger_sees_its_context_alone():
    t = tagger.random_tagger(["<sil>", "a", "b"])
    x = np.random.default_rng(2).normal(size=(60, N_MELS)).astype(np.float32)
    p = t.posteriors(x)
    assert p.shape == (60, 3) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    y, half = x.copy(), t.receptive_field // 2
    y[30] += 5
    moved = np.flatnonzero(np.abs(t.posteriors(y) - p).max(axis=1) > 1e-9)
    assert t.receptive_field == 1 + 4 * 2 + 2 * 3 and moved.min() >= 30 - half and moved.max() <= 30 + half
    assert t.n_params > 0


def test_probe(spark):
    ship(spark)
    t = tagger.random_tagger(["<sil>", "a", "b"])
    x = np.random.default_rng(3).normal(size=(50, N_MELS)).astype(np.float32)
    rows = spark.createDataFrame([("u", x.tolist(), [(1, 5, 15), (2, 48, 99), (1, 20, 21)]), ("v", None, [(1, 0, 9)])], "utt string, mel array<array<float>>, spans array<struct<class:int,start:int,end:int>>")
    hits = rows.select(F.explode(tagger.masked_hits_udf(spark, t, F.col("mel"), F.col("spans"), [0, 60])).alias("h")).select("h.*").cache()
    assert hits.count() == 6
    whole, far = ({(r["class"], r.hit) for r in hits.where(c).collect()} for c in ("margin is null", "margin = 60"))
    assert whole == far
    r = {(x.margin, x["class"]): x.n for x in runs.probe_report(hits, least=1).collect()}
    assert r[(-1, None)] == 2 and r[(0, 1)] == 1 and len(r) == 9
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    assert {x.margin: x.n for x in runs.probe_contrasts(hits, pairs).collect()} == {-1: 2, 0: 2, 60: 2}
    long = tagger.long_posteriors(rows.select("utt", tagger.posteriors_udf(spark, t, F.col("mel")).alias("p")), "p")
    assert long.count() == 150


def test_scores_and_schedule(spark):
    rows = spark.createDataFrame([("ab c", "ab c", "abc"), ("x", "xyz", None), (None, "", "")], "hyp string, ref string, src string")
    s = runs.text_scores(rows, "hyp", "ref", "src").first()
    assert s.n == 3 and s.exact == pytest.approx(2 / 3) and s.length_ratio == pytest.approx(5 / 7) and s.max_length_ratio == 1
    lr = [r[0] for r in spark.range(11).select(runs.learning_rate(F.col("id"), 10, 2)).collect()]
    assert lr[:3] == [0, 0.5, 1] and lr[6] == pytest.approx(0.5) and lr[10] == pytest.approx(0)


def test_artifacts(spark):
    files = spark.createDataFrame([("r/mel/a.npy", 5), ("r/mel/b.npy", 6)], "path string, length long")
    want = spark.createDataFrame([("mels", "%/mel/%"), ("index", "%/index/%")], "artifact string, pattern string")
    assert sorted(tuple(r) for r in runs.artifacts(want, files).collect()) == [("index", 0, 0, False), ("mels", 2, 11, True)]


def test_provenance(spark, tmp_path, capsys):
    corpus = spark.createDataFrame([("s", 3, 0.5)], "split string, utterances long, hours double")
    doc = runs.provenance(corpus, "split", {}, {"min_gap": 3}, {"lr": 0.1}, "twi", extra={"val": {"f1": 0.25}})
    assert doc["sources"] == {"s": {"dataset": "unknown"}} and doc["features"]["frame_ms"] == 10
    assert "f1=0.2500" in runs.describe(doc) and runs.model_card(doc, "T").startswith("# T")
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert cli.main(["info", str(tmp_path / "d.json")]) == 0 and "twi" in capsys.readouterr().out


def test_commands(spark, tmp_path):
    (tmp_path / "t.txt").write_text("me kɔ fie ntɛm\n\n1234\nna ɔba ha\n", encoding="utf-8")
    cli.main(["text-to-units", str(tmp_path / "t.txt"), "-o", str(tmp_path / "u"), "--per-word", "--drop-unchanged"])
    got = {r.text: r.units for r in spark.read.json(str(tmp_path / "u")).collect()}
    assert got["na ɔba ha"] == "n a | ɔ b a | h a" and len(got) == 2
    io.write_pairs(spark.createDataFrame([(f"a {k}", f"t{k}", "real", "s", str(k), None) for k in range(9)], io.PAIR), str(tmp_path / "real.jsonl"))
    cli.main(["finetune-data", str(tmp_path / "t.txt"), "--real", str(tmp_path / "real.jsonl"), "--ratio", "2", "-o", str(tmp_path / "mix"), "--report", str(tmp_path / "rep")])
    assert {r.origin: r["count"] for r in spark.read.json(str(tmp_path / "mix")).groupBy("origin").count().collect()} == {"synthetic": 2, "real": 4}
    assert spark.read.json(str(tmp_path / "rep")).first().used == 4
    with pytest.raises(SystemExit) as e:
        cli.main(["no-such"])
    assert e.value.code == 2
