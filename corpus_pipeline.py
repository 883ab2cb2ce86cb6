"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import language_id, mixing, near_dedup, packing, secret_scan
from loomspark.llm._common import cut, drop

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go.

    Null and empty texts have no letter; repeated rows stay or go alike; very long texts are parsed whole; a null id or language
    takes nothing from a row but its part in learning; an empty table gives an empty one; other columns stay as they are."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the least doc_id stays.

    All rows that hold that id stay, so repeated rows are not told apart; rows with a null id stay, as do those without words;
    an empty table gives an empty one; other columns stay as they are."""
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark, and n_chars follows the text; every row stays.

    Null texts stay null; repeated rows are redacted alike; very long texts are scanned whole; an empty table gives an empty one; other
    columns stay as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is repeated or thinned to its share, and all rows are shuffled.

    Copies keep their doc_id, and are rows of their own; a null source is a source; rows that repeat an id are repeated alike; an
    empty table gives an empty one; other columns stay as they are, with their names."""
    return mixing.shuffled(mixing.mix(docs), mixing.names(docs)[1]).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences, which are numbered in a random order.

    `row` tells copies of a document apart. Null and empty texts are one end id; very long texts are pieces of a sequence's length
    and a rest; ties go in any order; a null id stays null; an empty table gives an empty one."""
    return packing.pack(docs, seed=mixing.SEED)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, similarity groups and tokens are beyond SQL; tests/llm/test_pipeline.py holds the run against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if before is not None:
                drop(before)
            before = docs
    return docs
