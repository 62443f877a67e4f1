"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors unless their Python path has it already.

    Workers inherit PYTHONPATH and, in local mode, the working directory. On a cluster that was started with
    --py-files this does nothing beyond sending the same files again, once a session.
    """
    context = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == _ROOT for p in [*paths, os.getcwd()]) or getattr(context, "_lodestone_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"  # on the driver; Spark serves it to executors
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((_ROOT / "lodestone").rglob("*.py")):
            out.write(path, path.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._lodestone_shipped = True
