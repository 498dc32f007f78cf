"""The package for executors: a zip that Spark serves to them, once for each session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver runs from."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle.zip")
    Path(path).write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
