"""Brings the package's code to the executors, which share no folder with the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch at most: whole texts and pages are large, and executors hold several batches.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def ship_code(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers of this application, once. The driver serves the archive until it ends.

    Lowers the session's limits of an Arrow batch to ARROW_ROWS and ARROW_BYTES, if they are higher.
    """
    context = spark.sparkContext
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        set_to = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not set_to.isdigit() or not 0 < int(set_to) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="leafmill-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{top.name}_code.zip", "w") as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, path.relative_to(top.parent))
        context.addPyFile(f"{folder}/{top.name}_code.zip")
        _shipped.add(context.applicationId)
    return spark
