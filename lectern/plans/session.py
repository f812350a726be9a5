"""How the library reaches the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless PYTHONPATH names its folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # not before: executors fetch it when their first task comes
    path = Path(folder) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
