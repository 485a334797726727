"""Makes the package importable in Spark's Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def _workers_see_it(spark: SparkSession) -> bool:
    """Workers of a local master inherit the driver's folder and PYTHONPATH."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return spark.sparkContext.master.startswith("local[") and str(ROOT.parent) in places


def ship(spark: SparkSession) -> None:
    """Once a Spark application: hands the package's sources to Spark, which sends them to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    if _workers_see_it(spark):
        return
    target = f"{tempfile.mkdtemp(prefix='spark-knowmill-')}/{ROOT.name}.zip"  # the driver's own copy; executors fetch it from the driver
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(target)


def shipped(query):
    """The query, with the package shipped before it runs."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
