from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import audio, distance, hashing
from loomspark.functions.distance import edit_distance
from loomspark.functions.text import TWI, Language, get_language, missing_characters


def python_units(text: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    t = unicodedata.normalize("NFC", t).lower().translate({ord(k): v for k, v in TWI.fold.items()} | {ord(c): None for c in TWI.apostrophes})
    t = re.sub(rf"[^{TWI.alphabet}]+", " ", " ".join(w for w in t.split() if not any(c.isdecimal() for c in w)))
    return " ".join(re.findall(TWI.pattern, t))


@pytest.mark.parametrize("text,units", [("nkyekyɛmu", "n ky e ky ɛ m u"), ("adwuma", "a dw u m a"), ("nkuran", "n k u r a n"), ("w'aba", "w a b a"), ("me 2024 ba", "m e b a"), ("Ɔyɛ, ne ho!", "ɔ y ɛ n e h o"), ("' ' me", "m e"), ("ŋwene", "nw e n e"), ("ɪɴʊə", "i u e"), ("", "")])
def test_units(spark, text, units):
    got = spark.createDataFrame([(text,)], "t string").select(F.array_join(TWI.units(F.col("t")), " ")).first()[0]
    assert got == units


def test_units_of_noise(spark):
    rng = random.Random(1234)
    pool = "abkygwnɛɔŋéèñüß'’ 0129.,-\t\n ÀḈxyz"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.array_join(TWI.units(F.col("t")), " ").alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: python_units(t) for i, t in enumerate(texts)}


def test_starred(spark):
    df = spark.createDataFrame([("hwɛ me",), ("",)], "t string").select(F.array_join(TWI.tokens_starred(TWI.segment(F.col("t"))), " "))
    assert [r[0] for r in df.collect()] == ["<star> hw ɛ <star> m e <star>", "<star> <star>"]


def test_longest_match(spark):
    own = Language("x", "x", frozenset({"sch", "ch"}), frozenset("schaei"))
    assert spark.createDataFrame([("schaech",)], "t string").select(own.units(F.col("t"))).first()[0] == ["sch", "a", "e", "ch"]


def test_registry():
    assert get_language("tw") is TWI and len(TWI.inventory) == 38
    with pytest.raises(KeyError, match="twi"):
        get_language("xx")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances(spark):
    rng = random.Random(99)
    rows = [([str(rng.randrange(6)) for _ in range(rng.randrange(12))], [str(rng.randrange(6)) for _ in range(rng.randrange(12))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(distance.edit_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [levenshtein(a, b) for a, b in rows]
    r = spark.createDataFrame([("abc", "abd"), ("", "abc"), ("x", ""), ("", "")], "h string, r string").select(distance.cer(F.col("h"), F.col("r")), distance.wer(F.col("h"), F.col("r"))).collect()
    assert [x[0] for x in r] == [1 / 3, 1.0, 1.0, 0.0] and r[3][1] == 0.0


def test_split_shares(spark):
    df = spark.range(4000).select(F.concat(F.lit("sentence "), F.col("id")).alias("t")).select(hashing.split_of(F.col("t"), F.lit("real")).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] for r in df.collect()}
    assert 40 < n["val"] < 140 and 40 < n["test"] < 140 and n["train"] > 3700


def test_log_mel():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    m = audio.log_mel(x)
    assert m.shape == (101, 40) and m.mean(axis=0).argmax() == np.abs((700 * (10 ** (np.linspace(2595 * np.log10(1 + 20 / 700), 2595 * np.log10(1 + 7600 / 700), 42) / 2595) - 1))[1:-1] - 1000).argmin()


def plain_normal(text: str, lang: Language) -> str:
    """The definition, letter by letter: marks with a combining class go, letters fold all at once, words with a digit and foreign letters give way to spaces."""
    bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))).lower()
    folded = "".join("" if c in lang.apostrophes else lang.fold.get(c, c) for c in bare)
    words = [" " if any(unicodedata.category(c) == "Nd" for c in w) else w for w in re.split(r"(\s+)", folded)]
    return " ".join("".join(c if c in lang.alphabet else " " for c in "".join(words)).split())


def test_normal_form_by_definition(spark):
    odd = Language("odd", "Odd", frozenset({"ss", "ng"}), frozenset("abcdegnostz'") - {"'"}, {"ß": "ss", "s": "z", "ŋ": "ng", "x": "", "œ": "oe"}, {"z": "", "e": "ei"})
    texts = ["kaँba", "Straße ŋa xaxb œz", "é é ẹ́ ̖a", "a1b c d2 33 ٣x y", "don’t ‘a’", "", "ÅÄÖ åa𝅘𝅥 aᴖ5", "sß sŋ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", odd.normalize(F.col("t")).alias("n"), odd.segment(F.col("t")).alias("w"), odd.units(F.col("t")).alias("u"), TWI.normalize(F.col("t")).alias("twi")).collect()
    for r in got:
        assert re.sub(" +", " ", r.n) == plain_normal(r.t, odd) and re.sub(" +", " ", r.twi) == plain_normal(r.t, TWI), r.t
        words = [[u for u in re.findall(odd.pattern, w) if u != "z"] for w in plain_normal(r.t, odd).split()]
        assert r.w == [w for w in words if w] and r.u == [u for w in words for u in w]
    assert odd.silent == ["z"] and TWI.silent == []
    assert spark.range(1).select(odd.romanize_unit(F.lit("eaz")).alias("r")).first().r == "eia"


def test_missing_characters(spark):
    known = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrst"], "character string")
    assert [r.character for r in missing_characters(TWI, known).collect()] == list("uvwxyz")


def test_edit_distance_of_many_different_tokens(spark):
    n = 30_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("a"), i)).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("b"), i)).alias("b"))
    few = df.select(F.slice("a", 1, 60).alias("a"), F.concat(F.slice("a", 3, 50), F.slice("b", 1, 9)).alias("b"))
    assert few.select(edit_distance(F.col("a"), F.col("b")).alias("d")).first().d == 2 + 9
    # each of many different tokens has a character of its own, also beyond the surrogates
    n = 70_000
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("a"))
    assert long.select(edit_distance(F.slice("a", 69_990, 1), F.col("a")).alias("d")).first().d == n - 1
