"""Makes the package known to Python workers that wouldn't find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: adds the package to the workers' path, unless they inherit it from the driver.

    Workers see the driver's PYTHONPATH and, on one machine, its working directory. The archive is made on the driver only
    and sent by Spark itself.
    """
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    package = Path(__file__).resolve().parent.parent
    inherited = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == package.parent for p in inherited):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))


def ship_active() -> None:
    """:func:`ship` for the session at work, where functions are attached without a DataFrame at hand."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with a function of this package, whatever DataFrame it is attached to."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
