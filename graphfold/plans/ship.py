"""Sends the package to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[1]
        at = os.path.join(tempfile.mkdtemp(prefix="graphfold-"), f"{root.name}.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(at)
        _SENT.add(sc.applicationId)
    return spark
