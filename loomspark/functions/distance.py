"""Edit distances on tokens and characters, and the rates made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct tokens of a pair that can be told apart: as many as there are characters that can stand for one.
MOST_TOKENS = 0x110000 - 0x100 - 0x800 - 1


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays: each distinct token becomes a character of its own. More than MOST_TOKENS are an error."""
    seen = F.array_distinct(F.concat(a, b))

    def code(_: Column, i: Column) -> Column:
        # surrogates and the byte order mark, which decoding swallows, stand for nothing
        at = i + 0x100
        at = at + F.when(at >= 0xD800, 0x800).otherwise(0) + F.when(at >= 0xFEFF - 0x800, 1).otherwise(0)
        return F.decode(F.unhex(F.lpad(F.hex(at.cast("long")), 8, "0")), "UTF-32")

    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), seen.alias("d"))), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["d"].alias("d"), F.transform(s["d"], code).alias("c")))
    coded = lambda tokens, s: F.array_join(F.transform(tokens, lambda t: F.element_at(s["c"], F.array_position(s["d"], t).cast("int"))), "")
    many = F.raise_error(F.concat(F.lit("too many different tokens in a pair: "), F.size(seen).cast("string"))).cast("int")
    return F.when(F.size(seen) > MOST_TOKENS, many).otherwise(F.transform(bound, lambda s: F.levenshtein(coded(s["a"], s), coded(s["b"], s)))[0])


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def pair_uer(hyp: Column, ref: Column) -> Column:
    """Edits over reference tokens; an empty reference counts as 1."""
    return F.when(F.size(ref) == 0, F.lit(1.0)).otherwise(edit_distance(hyp, ref) / F.size(ref))


def cer(hyp: Column, ref: Column) -> Column:
    empty = F.when(hyp != "", F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(ref == "", empty).otherwise(F.levenshtein(hyp, ref) / F.char_length(ref))


def wer(hyp: Column, ref: Column) -> Column:
    h, r = split_words(hyp), split_words(ref)
    empty = F.when(F.size(h) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(r) == 0, empty).otherwise(edit_distance(h, r) / F.size(r))


def adjacent_repeats(units: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(units.alias("a"), F.slice(units, 2, F.greatest(F.size(units), F.lit(1))).alias("b")), lambda p: p["a"] == p["b"]))


def alignable(units: Column, frames: Column) -> Column:
    """Whether a monotonic alignment has room: equal neighbours need a frame between them."""
    return F.size(units) + adjacent_repeats(units) <= frames
