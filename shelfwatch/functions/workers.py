"""Letting Python workers import this package where it runs from a checkout instead of an installation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

import shelfwatch

FOLDER = str(Path(shelfwatch.__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Put the checkout on the workers' import path of this session. On a cluster install the package or ship it with
    ``--py-files``; the entry does no harm there."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if FOLDER not in known:
        environment["PYTHONPATH"] = ":".join(filter(None, [FOLDER, *known]))
