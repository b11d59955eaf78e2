"""Joining points with the intervals that hold them, as an equi-join.

Every interval is filed in cells of the smallest power of two that is at least its length, so it lies in one or two cells,
however long it is. A point lies in one cell of each width in use (there are at most 63, usually a few), so a pair meets
in exactly one cell: no pair comes twice and none needs ``distinct``. The equality on the keys, the width and the cell does the
shuffle and cuts a hot key into stretches; the exact comparison follows on the pairs that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("bigint"), level)


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Rows of both sides with equal ``keys`` and ``start`` <= ``at`` <= ``end``, all whole numbers: the keys, then the other
    columns of ``points`` and of ``intervals``, whose names must differ.

    Null keys and bounds match nothing, nor do intervals that end before they start. Reads the intervals once more to learn
    their widths.
    """
    length = F.col(end).cast("bigint") - F.col(start) + 1
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    filed = intervals.filter(length > 0).withColumn("_level", level)
    levels = filed.select("_level").distinct().agg(F.collect_set("_level").alias("levels"))
    in_cells = F.array_distinct(F.array(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level"))))
    filed = filed.withColumn("_cell", F.explode(in_cells))
    met = (
        points.withColumn("_level", F.explode(levels.scalar()))
        .withColumn("_cell", _cell(F.col(at), F.col("_level")))
        .join(filed, [*keys, "_level", "_cell"])
    )
    return met.filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_cell")
