"""Makes this package importable in Python workers, wherever a session was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session; Spark's file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_loamwork_shipped", None) is None:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="loamwork-")) / "loamwork.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._loamwork_shipped = str(archive)
