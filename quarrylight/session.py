"""Making the package importable wherever Spark runs Python."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once a Spark context, so that functions pickled by name load there."""
    sc = spark.sparkContext
    if not getattr(sc, "_quarrylight_shipped", False):
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quarrylight-")), "quarrylight.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(_ROOT):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quarrylight", os.path.relpath(full, _ROOT)))
        sc.addPyFile(path)
        sc._quarrylight_shipped = True
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, after the package was sent to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        return query(ship(spark), *args)

    return run
