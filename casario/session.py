"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per context, so that tasks can import it wherever it lies."""
    sc = spark.sparkContext
    if sc not in _SHIPPED:
        root = Path(__file__).parent
        d = tempfile.mkdtemp()  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        path = Path(d) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc)
    return spark
