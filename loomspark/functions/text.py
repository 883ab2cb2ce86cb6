"""Grapheme units of a language, compiled to column expressions: no Python runs on rows."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAR = "<star>"


def _accents() -> tuple[str, str]:
    """Characters that lose marks (those with a combining class), what is left of each, and then the marks themselves, which vanish."""
    src, dst, gone = [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.combining(c):
            gone.append(c)
            continue
        if not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))
        if len(bare) == 1 and bare != c:
            src.append(c)
            dst.append(bare)
    return "".join(src + gone), "".join(dst)


_MARKS = cache(_accents)


def mapped(text: Column, table: dict[str, str]) -> Column:
    """Each character that table has becomes what it says there, all at once; that may be no letter or several."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    many = {k: v for k, v in table.items() if len(v) != 1}
    # several letters go by way of a character of the private use area
    stand = {k: chr(0xF8FF - i) for i, k in enumerate(many)}
    out = F.translate(text, "".join([*one, *stand]), "".join([*one.values(), *stand.values()])) if table else text
    for k, v in many.items():
        out = F.replace(out, F.lit(stand[k]), F.lit(v))
    return out


@dataclass(frozen=True)
class Language:
    """Spelling of a language: multi-letter and single units, letters to fold, letters to romanise, contrasts to report."""

    code: str
    name: str
    multigraphs: frozenset[str]
    singles: frozenset[str]
    fold: dict[str, str] = field(default_factory=dict)
    romanize: dict[str, str] = field(default_factory=dict)
    # Characters that vanish inside words.
    apostrophes: str = "'’‘ʼ`´"
    contrasts: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if any(len(s) != 1 for s in self.singles) or any(len(m) < 2 for m in self.multigraphs):
            raise ValueError("single units have one letter, multigraphs several")

    @cached_property
    def inventory(self) -> list[str]:
        """Units in code-point order: a unit's place is its id."""
        return sorted(self.multigraphs | self.singles)

    @cached_property
    def alphabet(self) -> str:
        return "".join(sorted(self.singles | set("".join(self.multigraphs))))

    @cached_property
    def pattern(self) -> str:
        """Longest units first, so that the leftmost match is the longest."""
        many = sorted(self.multigraphs, key=lambda m: (-len(m), m))
        return f"({'|'.join([*many, '[' + ''.join(sorted(self.singles)) + ']'])})"

    @cached_property
    def silent(self) -> list[str]:
        """Units whose romanisation has no letter."""
        return [u for u in self.inventory if not re.sub("[^a-z]", "", "".join(self.romanize.get(c, c) for c in u))]

    def strip_accents(self, text: Column) -> Column:
        return F.translate(text, *_MARKS())

    def normalize(self, text: Column) -> Column:
        low = F.lower(self.strip_accents(text))
        folded = mapped(low, self.fold | dict.fromkeys(self.apostrophes, ""))
        # a word with a digit goes; it is looked at from its start alone
        words = F.regexp_replace(folded, r"(?U)(?<!\S)[^\s\p{Nd}]*+\p{Nd}\S*", " ")
        return F.trim(F.regexp_replace(words, f"[^{self.alphabet}]+", " "))

    def segment_word(self, word: Column) -> Column:
        return F.regexp_extract_all(word, F.lit(self.pattern), F.lit(1))

    def _spoken(self, units: Column) -> Column:
        return F.filter(units, lambda u: ~u.isin(self.silent)) if self.silent else units

    def units(self, text: Column) -> Column:
        """All units of a text that have a romanisation; no unit spans a space."""
        return self._spoken(F.regexp_extract_all(self.normalize(text), F.lit(self.pattern), F.lit(1)))

    def segment(self, text: Column) -> Column:
        """array<array<string>>: units by word; units without a romanisation and words left empty go."""
        words = F.transform(F.split(self.normalize(text), " "), lambda w: self._spoken(self.segment_word(w)))
        return F.filter(words, lambda w: F.size(w) > 0)

    def romanize_unit(self, unit: Column) -> Column:
        return F.regexp_replace(mapped(unit, self.romanize), "[^a-z]", "")

    def aligner_token(self, unit: Column) -> Column:
        return F.array_join(F.filter(F.split(self.romanize_unit(unit), ""), lambda c: c != ""), " ")

    def tokens_starred(self, words: Column) -> Column:
        """Wildcards at both ends and between words, never inside one; two of them where there are no words."""
        inner = F.flatten(F.transform(words, lambda w: F.concat(w, F.array(F.lit(STAR)))))
        return F.when(F.size(words) == 0, F.array(F.lit(STAR), F.lit(STAR))).otherwise(F.concat(F.array(F.lit(STAR)), inner))


# The orthography's units, folds and contrasts.
DIGRAPHS = frozenset({"ky", "gy", "hy", "ny", "tw", "dw", "kw", "gw", "hw", "nw"})
VOWELS = frozenset("aeɛioɔu")
CONSONANTS = frozenset("bdfghklmnprstwy")
FOREIGN = frozenset("cjqvxz")
FOLD = {
    "ŋ": "n", "ɲ": "n", "ɩ": "i", "ɪ": "i", "ʊ": "u", "ə": "e", "ɐ": "a",
    "ʃ": "s", "ʒ": "z", "ɡ": "g", "æ": "a", "ø": "o", "œ": "o", "ß": "s",
    "ð": "d", "þ": "t", "đ": "d", "ħ": "h", "ł": "l",
}
CONTRASTS = (("ɛ", "e"), ("ɔ", "o"), ("ky", "gy"), ("tw", "dw"), ("hy", "hw"), ("ny", "nw"), ("k", "kw"))

TWI = Language("twi", "Twi (Asante)", DIGRAPHS, VOWELS | CONSONANTS | FOREIGN, FOLD, {"ɛ": "e", "ɔ": "o"}, contrasts=CONTRASTS)

LANGUAGES: dict[str, Language] = {"twi": TWI}
ALIASES: dict[str, str] = {"tw": "twi", "aka": "twi", "ak": "twi"}


def missing_characters(language: Language, known: DataFrame, column: str = "character") -> DataFrame:
    """Letters that the language's romanised units need and an aligner's vocabulary (known) lacks, by letter; an empty result lets it load."""
    needed = sorted({c for u in language.inventory for c in re.sub("[^a-z]", "", "".join(language.romanize.get(x, x) for x in u))})
    wanted = known.sparkSession.sql("SELECT explode(split('" + ",".join(needed) + f"', ',')) AS {column}")
    return wanted.join(known, column, "left_anti").orderBy(column)


def get_language(code: str) -> Language:
    key = ALIASES.get(code.lower(), code.lower())
    if key not in LANGUAGES:
        raise KeyError(f"unknown language {code!r}; there are {sorted(LANGUAGES)}")
    return LANGUAGES[key]


def register(language: Language, *aliases: str) -> Language:
    LANGUAGES[language.code] = language
    ALIASES.update(dict.fromkeys(aliases, language.code))
    return language
