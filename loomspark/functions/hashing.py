"""Content hashes: splits that keep duplicates together, and fingerprints."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_bucket(text: Column) -> Column:
    """0 to 99 from the first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 100


def split_of(text: Column, origin: Column, val_pct: int = 2, test_pct: int = 2) -> Column:
    """train, val or test by the text; clean rows always train."""
    b = text_bucket(text)
    return F.when(origin.isin("clean-text", "clean-ref"), "train").when(b < val_pct, "val").when(b < val_pct + test_pct, "test").otherwise("train")


def unit_interval(key: Column) -> Column:
    """[0, 1) from the first 64 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def subset_of(bucket: Column, val: float, test: float) -> Column:
    return F.when(bucket < F.lit(val).cast("float"), "val").when(bucket < F.lit(val + test).cast("float"), "test").otherwise("train")


def order_key(seed: int, key: Column) -> Column:
    """What a seeded shuffle or draw sorts by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """Twelve hex digits over the sorted rows of a small listing."""
    rows = F.array_sort(F.collect_list(F.concat_ws(":", *[F.col(c).cast("string") for c in cols])))
    return df.agg(F.substring(F.sha1(F.array_join(rows, "").cast("binary")), 1, 12).alias("fingerprint"))


def config_key(config: dict[str, Any]) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
