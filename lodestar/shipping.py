"""Sends this package to Python workers, which may run where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors the package once for each Spark application; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lodestar-py-")) / "lodestar.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path("lodestar") / p.relative_to(top))
    sc.addPyFile(str(archive))
    sc._lodestar_shipped = True
