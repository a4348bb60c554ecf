"""The package for tasks: their Python must import it wherever a job's driver was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application. Spark serves the archive from the driver."""
    context = spark.sparkContext
    if context.applicationId not in _done:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ledgerlight_package_")) / "ledgerlight_core.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _done.add(context.applicationId)
