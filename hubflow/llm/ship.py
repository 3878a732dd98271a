"""Prepare a session for the operators that run Python in tasks.

The package becomes importable in Python workers wherever the driver found
it, and Arrow batches are bounded by bytes, as whole texts travel in them.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "_hubflow_shipped"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the session's workers, once per context.

    ``addPyFile`` serves the archive from the driver, so no folder has to be
    shared; with the package installed on the executors it changes nothing.
    A smaller bound on Arrow batches than BATCH_BYTES is kept."""
    now = spark.conf.get(_BATCH, str(BATCH_BYTES + 1)).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="hubflow-"), "hubflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("hubflow", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    setattr(sc, _SHIPPED, True)
