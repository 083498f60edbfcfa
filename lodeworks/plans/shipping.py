"""The package on the executors: workers need it to unpickle the functions that run over Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hands the package to Spark once per context, which serves it to every executor, now and later."""
    context = spark.sparkContext
    if getattr(context, "_lodeworks_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="lodeworks-")) / "lodeworks_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root).as_posix()}")
        context.addPyFile(str(archive))
    context._lodeworks_shipped = True
