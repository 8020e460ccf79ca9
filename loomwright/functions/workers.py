"""The package on the Python workers' path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they find it on their path as it is."""
    package = Path(__file__).resolve().parents[1]
    root, context = str(package.parent), spark.sparkContext
    if root in [os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":"))]:
        return
    if getattr(context, "_loomwright_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="loomwright-")  # the driver's; Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._loomwright_sent = True
