"""Makes the package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to this application's Python workers, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, sending the package first."""

    @wraps(query)
    def run(spark: SparkSession, *rest: object) -> DataFrame:
        ship(spark)
        return query(spark, *rest)

    return run
