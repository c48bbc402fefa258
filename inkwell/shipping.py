"""The package for Python workers on other machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to all executors, once per application; Spark's own file server hands them out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as packed:
        for module in sorted(root.rglob("*.py")):
            packed.write(module, module.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
