"""Gaps and islands: number the maximal stretches of an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_island_id(df: DataFrame, keys: list[str], order: str, opens: Column, name: str) -> DataFrame:
    """Add ``name``: how many rows of the same key up to and including this one satisfy ``opens``.

    Rows that share the number form one island. The window is partitioned by ``keys`` only, so a
    following ``groupBy(*keys, name)`` runs on the same exchange.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.count(F.when(opens, 1)).over(upto))
