"""The package, sent to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every worker the package, once per application, whatever folder the driver started in."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="dugout-ship-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)
