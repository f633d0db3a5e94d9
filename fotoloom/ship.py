"""The package for Python workers that cannot import it from where the driver does."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="fotoloom-")) / "fotoloom.zip"
    path.write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
