"""Hands the package to the executors where their Python path lacks it."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the application, once; nothing if PYTHONPATH or the installation has it already."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *(p for p in sys.path if p.endswith("-packages"))]
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and not any(p and Path(p).resolve() == _ROOT.parent for p in paths):
        target = Path(tempfile.mkdtemp(prefix="palimpsest-zip-")) / "palimpsest.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(_ROOT.rglob("*.py")):
                z.write(f, f.relative_to(_ROOT.parent))
        spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
    return spark
