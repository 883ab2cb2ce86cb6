"""The pipeline against a version in plain Python, and its stages on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomspark.llm import _common, language_id, mixing, near_dedup, packing, secret_scan
from tests.llm.test_llm import base_spans, near_groups, p_random, phrases
from tests.test_oracle import SF

MIXED = re.compile(secret_scan.MIXED)


def letters(text: str) -> bytes:
    return re.sub(rb" +", b" ", bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()))


def known_language(text: str, model: dict[str, bytes]) -> bool:
    x = letters(text)
    # a leading run of spaces counts one, as any other
    counts = {lang: phrases(x, sample) for lang, sample in model.items()}
    best = min(sorted(counts), key=lambda lang: counts[lang] * math.log2(len(model[lang])))
    usual = len(x) / language_id.LEAST_PHRASE
    return counts[best] <= usual + language_id.DEVIATIONS * math.sqrt(usual)


def redacted(texts: list[str]) -> list[str]:
    runs = [[(m.start(), m.end(), m[0]) for m in re.finditer(secret_scan.RUN, t) if MIXED.search(m[0])] for t in texts]
    pieces = lambda a, v: [(a + m.start(), a + m.end(), m[0]) for m in re.finditer(secret_scan.PIECE, v) if "/" in v and MIXED.search(m[0])]
    step = lambda v: min(math.floor(-math.log10(max(p_random(v), 1e-16)) * secret_scan.STEPS), secret_scan.LAST)
    kind = lambda v: sum(len(v) >= n for n in secret_scan.CLASSES) - 1
    tokens = {v for r in runs for a, _, run in r for _, _, v in [(0, 0, run), *pieces(a, run)]}
    least = {k: secret_scan.least_step(collections.Counter(step(v) for v in tokens if kind(v) == k)) for k in {kind(v) for v in tokens}}
    said = lambda v: step(v) < least[kind(v)]
    out = []
    for t, found in zip(texts, runs, strict=True):
        spans = [(a, b) for a, _, b in base_spans(t)]
        more = [x for a, b, v in found for x in ([(a, b)] if said(v) else [(c, d) for c, d, w in pieces(a, v) if said(w)])]
        spans = sorted(spans + [(a, b) for a, b in more if not any(c < b and a < d for c, d in spans)])
        made, at = "", 0
        for a, b in spans:
            if b > at:
                made, at = made + (t[at:a] + secret_scan.MARK if a >= at else ""), max(at, b)
        out.append(made + t[at:])
    return out


def copies(key: str, rate: float) -> int:
    total, draws = 0, max(1, math.ceil(rate / mixing.MOST_RATE))
    for k in range(1, draws + 1):
        u = int(hashlib.md5(f"{mixing.SEED}:{key}{f':{k}' if k > 1 else ''}".encode()).hexdigest()[: mixing.BITS // 4], 16) / 2**mixing.BITS
        p = c = math.exp(-rate / draws)
        i = 0
        while u >= c:
            i += 1
            p *= rate / draws / i
            c += p
            total += 1
    return total


def test_pipeline_against_plain_python(spark, tmp_path):
    """Over the documents of the smallest table, with secrets in every fifth."""
    key = F.substring(F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 512))), 1, 60)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    given.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(' secret: "'), F.md5("text"), F.lit('" and '), key, F.lit(" end"))).otherwise(F.col("text"))).write.parquet((tmp_path / "documents.parquet").as_uri())
    docs = spark.read.parquet((tmp_path / "documents.parquet").as_uri())
    table = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    model = language_id.fit(docs)
    kept = [r for r in table if any(c.isalpha() for c in r[1]) and known_language(r[1], model)]
    assert len(kept) > 0.9 * len(table)
    stays = {i for i, _, c in near_groups([r[:2] for r in kept], 5) if i == c}
    kept = [r for r in kept if r[0] in stays]
    kept = [(i, t, s) for (i, _, s), t in zip(kept, redacted([t for _, t, _ in kept]), strict=True)]
    assert sum(t.count(secret_scan.MARK) > 1 for _, t, _ in kept) > 10
    n = collections.Counter(s or "" for _, _, s in kept)
    weight = {s: c**mixing.TEMPERATURE for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(kept) / n[s] for s in n}
    tok = Tokenizer.from_file(_common.token_path(packing.VOCABULARY))
    want: collections.Counter = collections.Counter()
    for i, t, s in kept:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += copies(str(i), rate[s or ""])
    got = corpus_pipeline.run(spark, tmp_path.as_uri()).toPandas()
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == +want
    assert not got[["row", "piece"]].duplicated().any()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_keep_columns_and_survive_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns of the names that operators use."""
    text = "the house of the people was in the water and it is on the table with them"
    table = [(1, text, "en", "a", 73), (1, text, "en", "a", 73), (1, text + " again and some more words of its own", "en", "b", 1), (2, text.upper(), None, None, None), (3, None, "en", "a", None), (4, "", None, "a", 0), (None, "a text without an id that is of the people", "en", "a", 3), (None, None, None, None, None), (5, "12 34", "en", "b", 5), (6, (text + " and then ") * 3000, "en", "c", 9), (7, text[::-1] + ' password = "hunter2hunter2"', "en", "c", 9)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ("_copy", "_order", "_dropped", "row", "base", "spans", "id", "component_id", "key", "length", "piece", "rate")})
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in at.collect()}
        at = _common.cut(stage(spark, at, SF))
        assert at.columns == docs.columns and {r.doc_id for r in at.collect()} <= before, name
        if name == "language_id":
            assert before - {r.doc_id for r in at.collect()} == {3, 4, 5}
        if name == "near_dedup":
            assert sorted((r.doc_id for r in at.collect()), key=repr) == [1, 1, 1, 6, 7, None]
        if name == "secret_scan":
            row = at.where("doc_id = 7").first()
            assert row.text.endswith(secret_scan.MARK + '"') and row.n_chars == len(row.text) and row.base == "base"
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= at.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Told:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), type("S", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        _common.scratch_dir(Told)


def test_a_worker_keeps_tables_of_one_operator():
    """Workers outlive their stage: what packing and language ID remember must not stand beside near-dedup and the scan for secrets."""

    class Here:
        """One worker, and a task of a few rows."""

        def mapInArrow(self, f, schema):
            return list(f(iter([pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["some words " * 20_000, ""]})])))

    text = b"abc def " * 100
    packing.WordIds.of(_common.token_path(packing.VOCABULARY)).encode(text)
    language_id.Parser.of({"en": text, "fr": text[3:]})
    first, second = near_dedup.full_sets(Here(), 5)[0]["shingles"].to_pylist()
    assert (len(first), len(second)) == (8 * 2, 0)
    assert not packing.WordIds.made and not language_id.Parser.made
    assert all(p.up.nbytes + p.down.nbytes < 1000 for p in _common._POWERS.values())
    coder = packing.WordIds.of(_common.token_path(packing.VOCABULARY))
    assert list(_common.lean("packing", iter)([1, 2])) == [1, 2] and packing.WordIds.of(_common.token_path(packing.VOCABULARY)) is coder
