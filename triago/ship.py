"""Makes this package importable in Python workers that would not find it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless their path or working folder already leads to
    it. Spark serves the archive from the driver, so executors need no shared folder for it."""
    context = spark.sparkContext
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _SHIPPED or str(ROOT) in path or (context.master.startswith("local[") and Path.cwd() == ROOT):
        return
    folder = tempfile.mkdtemp(prefix="triago-")
    archive = os.path.join(folder, f"triago-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in (*ROOT.glob("triago/**/*.py"), *ROOT.glob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves it from there until the end
    _SHIPPED.add(context.applicationId)
