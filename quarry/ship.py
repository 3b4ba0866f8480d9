"""The package's modules for executors that have no copy of their own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application: what runs in Python there is found by its name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarry-")  # of code alone; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "quarry-code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
