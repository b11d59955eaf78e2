"""Exact ranks and quantiles without putting a whole group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer and an ordered window puts the whole group
into one task. Neither survives a group that holds a third of all rows. Here the values are ordered by ranges:

1. equal values collapse to one row with a count (map-side combined);
2. these rows are range-partitioned by group and value and written once, each with the number of its partition, so a large
   group lies in many partitions;
3. the counts per group and partition give each partition its rank offset within the group;
4. a running sum inside (group, partition) adds the rest of the rank.

There is one path for tables of any size; the number of partitions is the session's shuffle setting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store


@dataclass(frozen=True)
class RankIndex:
    """``values``: groups, value (NULL included), ties, part. Read once from the input, however often it is used."""

    groups: list[str]
    values: DataFrame

    @property
    def part_key(self) -> list[str]:
        return [*self.groups, "part"]

    @property
    def known(self) -> DataFrame:
        return self.values.filter(F.col("value").isNotNull())

    def sizes(self) -> DataFrame:
        """Number of values per group, ``n``."""
        return self.known.groupBy(*self.groups).agg(F.sum("ties").alias("n"))

    def offsets(self) -> DataFrame:
        """groups, part, before: how many values of the group lie in earlier partitions. A row per group and partition."""
        earlier = Window.partitionBy(*self.groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return (
            self.known.groupBy(*self.part_key).agg(F.sum("ties").alias("inside"))
            .select(*self.part_key, F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))
        )

    def ranks(self) -> DataFrame:
        """groups, part, value, ties, last_rank: the highest 1-based rank among the ties."""
        upto = (
            Window.partitionBy(*self.part_key).orderBy("value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return (
            self.known.withColumn("within", F.sum("ties").over(upto))
            .join(self.offsets(), self.part_key)
            .select(*self.part_key, "value", "ties", (F.col("before") + F.col("within")).alias("last_rank"))
        )


def rank_index(df: DataFrame, groups: list[str], value: Column | str) -> RankIndex:
    """Collapse, order and write the values of each group. Runs the jobs that do so."""
    value = F.col(value) if isinstance(value, str) else value
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.groupBy(*groups, value.alias("value")).agg(F.count("*").alias("ties"))
        .repartitionByRange(parts, *groups, "value")
        .withColumn("part", F.spark_partition_id())
    )
    return RankIndex(groups, store(ordered, "ranks"))


def values_at(index: RankIndex, wanted: DataFrame) -> DataFrame:
    """Add ``value``, the order statistic at ``rank``, to every row of ``wanted``.

    Wanted ranks and the first ranks of the partitions are merged in rank order, which places each rank in a partition (as
    many rows per group as there are partitions and wanted ranks). Inside the partition, wanted ranks and values are merged
    the same way and each rank takes the nearest value at or above it. One pass each, no pairs.
    """
    starts = index.offsets().select(*index.groups, (F.col("before") + 1).alias("rank"), "part", F.lit(False).alias("wanted"))
    so_far = (
        Window.partitionBy(*index.groups).orderBy("rank", "wanted")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        starts.unionByName(wanted.withColumn("wanted", F.lit(True)), allowMissingColumns=True)
        .withColumn("part", F.last("part", ignorenulls=True).over(so_far))
        .filter("wanted")
    )
    from_above = (
        Window.partitionBy(*index.part_key).orderBy(F.desc("rank"), F.col("wanted"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        index.ranks().select(*index.part_key, "value", F.col("last_rank").alias("rank"), F.lit(False).alias("wanted"))
        .unionByName(placed, allowMissingColumns=True)
        .withColumn("value", F.last("value", ignorenulls=True).over(from_above))
        .filter("wanted")
        .drop("wanted", "part")
    )


def medians(index: RankIndex, min_rows: int = 1) -> DataFrame:
    """Exact median per group with at least ``min_rows`` values: groups, n, median."""
    n = F.col("n")
    middle = index.sizes().filter(n >= min_rows).select(
        *index.groups, "n", F.explode(F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1)).alias("rank")
    )
    return values_at(index, middle).groupBy(*index.groups, "n").agg(F.avg("value").alias("median"))


def quantile(index: RankIndex, q: float, name: str) -> DataFrame:
    """Exact linear-interpolation quantile per group: groups, ``name``."""
    position = F.lit(q) * (F.col("n") - 1)
    wanted = index.sizes().select(
        *index.groups, (position - F.floor(position)).alias("weight"),
        F.explode(F.array_distinct(F.array(F.floor(position) + 1, F.ceil(position) + 1))).alias("rank"),
    )
    low, high = F.min("value"), F.max("value")
    return values_at(index, wanted).groupBy(*index.groups).agg((low + (high - low) * F.max("weight")).alias(name))
