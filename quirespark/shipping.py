"""Makes sure that executors can import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of a batch that goes to a Python worker: several of them are held at once, by the JVM and by the worker.
ARROW_BYTES = 4 << 20
_DEFAULT_ARROW_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Ships this package, once for each session, to executors whose Python path doesn't name it already.

    Batches for Python workers are cut by bytes, unless the session's own setting is smaller.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(_DEFAULT_ARROW_BYTES)).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or getattr(context, "_quirespark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quirespark-"), "quirespark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._quirespark_shipped = True
