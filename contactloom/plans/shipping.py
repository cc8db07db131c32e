"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_on_workers(spark: SparkSession) -> None:
    """Sends the package to executors unless their path already has it (started beside it, or by PYTHONPATH)."""
    package = Path(__file__).resolve().parents[1]
    home = str(package.parent)
    paths = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    application = spark.sparkContext.applicationId
    if home in paths or application in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
