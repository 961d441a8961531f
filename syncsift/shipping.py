"""Sends this package to the Python workers, which need not have it installed nor share the driver's folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application; the archive is served by the driver."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="syncsift-code-")) / "syncsift_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, str(path.relative_to(package.parent)))
        sc.addPyFile(str(archive))
        _sent.add(sc.applicationId)
    return spark
