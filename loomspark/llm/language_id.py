"""Language ID by cross-parsing entropy.

Of each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily, from its
first byte to its last, into the longest phrases that occur in that sample; c phrases over n letters against a sample of N letters give
c * log2(N) / n bits a letter, and the language with the fewest wins. Stretches of a text are parsed side by side as if each began
a phrase, and then again from the state that the stretch before has left, as far as that makes a difference, so that the
phrases are those of one parse from left to right.

Defined results: null text and text without a letter give `und` and score 0; with no labelled text at all every text
gives `und`; a tie goes to the language that sorts first; repeated rows are scored alike, as are rows that repeat an id; very long texts are
parsed whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._common import KEPT, keep_only, lean, prepare, slices

#: Bounds of the fit: texts drawn for each language, and letters of each, from a hashed place in it.
FIT_TEXTS, FIT_EACH = 48, 500
#: Length of the stretches that are parsed side by side, in bytes.
STRETCH = 128
#: A text is in none of the languages if it has more phrases than mean ones of LEAST_PHRASE bytes would be, by DEVIATIONS of chance.
LEAST_PHRASE, DEVIATIONS = 1.9, 2.0
_FLAG, _PAD, _OTHER = 1 << 30, 1, 2


def _classes() -> np.ndarray:
    """Byte to letter byte; what isn't a letter becomes a space. Texts are lower-cased before."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_CLASS = _classes()


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with single spaces between, and where each text now starts."""
    x = _CLASS[data]
    keep = x != 32
    keep[1:] |= keep[:-1].copy()
    keep[off[:-1][off[:-1] < len(x)]] = True
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def automaton(text: bytes, code: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton, flat; a missing one begins the next phrase, and carries a flag."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in code[np.frombuffer(text, np.uint8)].tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nexts[p]:
            nexts[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(ch) == q:
                    nexts[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    dead = len(nexts)  # after a byte that occurs nowhere: whatever follows begins a phrase
    root = np.full(width, dead, np.int32)
    root[list(nexts[0])] = list(nexts[0].values())
    table = np.tile(root | _FLAG, (dead + 1, 1))
    table[0] = root
    state = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
    table[state, [c for x in nexts for c in x]] = [s for x in nexts for s in x.values()]
    table[:, _PAD] = 0
    return table.ravel()


class Parser:
    """Automata of all languages, built once in each Python worker."""

    made: dict[tuple, Parser] = {}

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        seen = sorted(set(b"".join(texts.values())))
        self.code = np.full(256, _OTHER, np.int32)
        self.code[seen] = np.arange(3, 3 + len(seen))
        self.width = 3 + len(seen)
        self.tables = [automaton(texts[x], self.code, self.width) for x in self.langs]
        self.bits = np.array([np.log2(max(2, len(texts[x]))) for x in self.langs])

    @classmethod
    def of(cls, texts: dict[str, bytes]) -> Parser:
        key = tuple(sorted(texts.items()))
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = cls(texts)
        return cls.made[key]

    def phrases(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the number of phrases; the number of letters."""
        x, at = letters(data, off)
        n = np.diff(at)
        each = -(-n // STRETCH)
        text = np.repeat(np.arange(len(n)), each)
        first = at[:-1][text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each))
        out = np.zeros((len(n), len(self.langs)))
        if not len(text):
            return out, n
        left = np.minimum(at[1:][text] - first, STRETCH)
        codes = np.append(self.code[x], _PAD)
        step = np.arange(STRETCH)[:, None]
        grid = codes[np.where(step < left, first + step, len(x))]
        begins = np.concatenate(([True], text[1:] != text[:-1]))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(text, self._stretches(table, grid, begins) + begins, len(n))
        return out, n

    def _stretches(self, table: np.ndarray, grid: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Phrases that begin within each stretch, but for a text's first one."""
        steps, many = grid.shape
        trail = np.empty((steps, many), np.int32)
        state, count = np.zeros(many, np.int32), np.zeros(many, np.int32)
        for row, kept in zip(grid, trail, strict=True):
            state *= self.width
            state += row
            table.take(state, out=kept, mode="clip")
            count += kept >> 30
            np.bitwise_and(kept, _FLAG - 1, out=state)
        # from the state that the stretch before has left, until both parses are in one state; if they never are, the next stretch is due
        due = np.flatnonzero(~begins)
        entry = state[due - 1]
        due, entry = due[entry != 0], entry[entry != 0]
        while len(due):
            lanes, at = due, entry
            for row, kept in zip(grid, trail, strict=True):
                now, was = table.take(at * self.width + row[lanes]), kept[lanes]
                count[lanes] += (now >> 30) - (was >> 30)
                kept[lanes] = now
                apart = (now ^ was) & (_FLAG - 1) != 0
                lanes, at = lanes[apart], (now & (_FLAG - 1))[apart]
                if not len(lanes):
                    break
            due = lanes + 1
            inside = due < many
            due, entry = due[inside], at[inside]
            going = ~begins[due]
            due, entry = due[going], entry[going]
        return count


KEPT["language_id"] = Parser.made


def foreign(phrases: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether phrases over n letters are too many for any of the languages."""
    usual = n / LEAST_PHRASE
    return phrases > usual + DEVIATIONS * np.sqrt(usual)


def predict(texts: pa.Array, model: dict[str, bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, mean phrase length of lower-cased texts, and whether they are foreign to all languages."""
    scores, means, alien = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model:
        return ["und"] * len(texts), scores, means, alien
    parser = Parser.of(model)
    langs: list[str] = []
    for lo, hi, data, off in slices(texts):
        count, n = parser.phrases(data, off)
        bits = count * parser.bits / np.maximum(n, 1)[:, None]
        best = bits.argmin(axis=1)
        rows = np.arange(hi - lo)
        odds = np.exp(-4 * (bits - bits[rows, best][:, None]))
        langs += [parser.langs[b] for b in best]
        scores[lo:hi] = 1 / odds.sum(axis=1)
        means[lo:hi] = n / np.maximum(count[rows, best], 1)
        alien[lo:hi] = foreign(count[rows, best], n)
    return langs, scores, means, alien


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Labelled letters for each language: of FIT_TEXTS texts by the order of their hashes, FIT_EACH letters of each, from a hashed place on.

    The sample alone is bounded; every row stands for the draw, and each partition sends FIT_TEXTS a language at most."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    wide = 2 * FIT_EACH
    place = F.pmod("h", F.greatest(F.length("text") - wide, F.lit(0)) + 1).cast("int") + 1
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    drawn = hashed.select("doc_id", "lang", "h", F.lower(F.substring("text", place, F.lit(wide))).alias("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIT_TEXTS).orderBy("lang", "n")
    out: dict[str, bytes] = {}
    for row in drawn.collect():
        raw = np.frombuffer(row.text.encode(), np.uint8)
        x, _ = letters(raw, np.array([0, len(raw)]))
        out[row.lang] = out.get(row.lang, b"") + x[:FIT_EACH].tobytes() + b" "
    return out


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, lang_pred, score, phrase (mean phrase length), rejected."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, means, alien = predict(b["text"], model)
            und = ~b["letter"].to_numpy(zero_copy_only=False).astype(bool) | np.array([x == "und" for x in langs], bool)
            lang = pc.if_else(pa.array(und), "und", pa.array(langs, pa.string()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], lang, pa.array(np.where(und, 0.0, scores)), pa.array(means), pa.array(und | alien)], ["doc_id", "lang_pred", "score", "phrase", "rejected"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return narrow.mapInArrow(lean("language_id", run), "doc_id long, lang_pred string, score double, phrase double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs without those that are rejected: no letter, or too many phrases for any of the languages; with no labelled text, only those without a letter go. All columns stay."""
    prepare(docs.sparkSession)

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        keep_only("language_id")
        return pa.array(~predict(texts, model)[3])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(text.rlike(r"\p{L}")).where(fits(F.lower(text)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
