"""Give the executors this package, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: str | None = None


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once."""
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="quireflow-")) / "quireflow_package.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped = spark.sparkContext.applicationId
