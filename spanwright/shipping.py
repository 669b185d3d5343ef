"""Python that runs on executors must be importable there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "spanwright_package.zip"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; they need not have it installed."""
    context = spark.sparkContext
    if any(x.endswith(NAME) for x in context._python_includes):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="spanwright-")) / NAME
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(at))
