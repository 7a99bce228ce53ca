"""Sends this package to the executors, for clusters on whose machines it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; executors fetch the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    top = Path(__file__).resolve().parent
    if not top.is_dir():  # this is the shipped copy itself
        return
    target = Path(tempfile.mkdtemp(prefix="spindrift-ship-")) / "spindrift.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
