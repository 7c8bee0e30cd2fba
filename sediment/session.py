"""Gets the package itself to Python workers, wherever they run."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's files once, so that workers can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_sediment_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        at = tempfile.mkdtemp(prefix="sediment-code-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{at}/sediment", "zip", root, "sediment"))
        sc._sediment_shipped = True
    return spark
