"""What a session needs before Python workers can import this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(), "loomspark.zip")
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted((root / "loomspark").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(str(made))
        _SHIPPED.add(app)


def build(name: str = "loomspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; master and partitions are left to the cluster unless they are given."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
