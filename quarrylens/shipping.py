"""Makes the package importable where Spark runs Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their path already has it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    there = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if root in there or getattr(context, "_quarrylens_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="quarrylens-")) / "quarrylens.zip"  # the driver serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "quarrylens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    context._quarrylens_shipped = True
