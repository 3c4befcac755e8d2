"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_vectorloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="vectorloom-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
    sc.addPyFile(f.name)
    atexit.register(Path(f.name).unlink, missing_ok=True)  # executors have copies of their own
    sc._vectorloom_shipped = True
