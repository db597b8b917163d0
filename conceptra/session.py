"""What a session needs to run this package's Python functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import the package from where it lies, whatever folder the driver was started in.

    Where executors do not share that place, ship the package (``--py-files``) as usual; the entry does no harm.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
