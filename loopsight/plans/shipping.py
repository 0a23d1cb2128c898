"""Gives the package to the executors, so that jobs don't depend on how they were started."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .registry import Query

_given: set[str] = set()


def give_package(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once."""
    if spark.sparkContext.applicationId in _given:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _given.add(spark.sparkContext.applicationId)


def with_package(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        give_package(spark)
        return query(spark, sf_dir)

    return run
