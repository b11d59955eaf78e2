"""Sharding by global byte-size prefix sums.

Documents stand in one global order (doc_id, then the text's digest). The order is cut into equal byte targets:

1. rows without their text are range-partitioned by that order; each partition is sorted and numbered as a stream, with
   running bytes, and written once;
2. the totals of the partitions give each partition its offset (as many rows as there are partitions);
3. offset + running bytes is the global prefix sum, and the shard is the equal target that holds a document's middle byte;
4. the first global row of each shard turns global row numbers into slots.

A hot doc_id, or a third of all rows being the same row, is spread: the third sort key tells repeated rows apart by where
they lie. They are equal, so their order among themselves does not show in the result.

Defined cases: a null text has no bytes (size 8, crc32 of nothing). Null ids come first. An empty table gives an empty
result. Documents larger than a target leave neighbouring shards without rows. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import text_of

ROW_BYTES = 8  # what a row costs besides its text


def _running(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of a sorted partition and sum the bytes before each."""
    rows = total = 0
    for part in parts:
        ends = part["size"].cumsum() + total
        part["row"] = range(rows, rows + len(part))
        part["before"] = ends - part["size"]
        if len(part):
            rows, total = rows + len(part), int(ends.iloc[-1])
        yield part


def prefix_sums(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, size, text_crc32, and for each row the global number of rows (``row``) and bytes (``before``)
    before it and of all bytes (``total``)."""
    text = text_of()
    rows = documents.select(
        *keep, (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.md5(text).alias("_digest"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_place"),
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_id", "_digest", "_place"]
    plain = [c for c in rows.columns if c not in order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(plain).schema)
    numbered = store(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(plain)
        .mapInPandas(_running, f"{schema}, row bigint, before bigint")
        .withColumn("part", F.spark_partition_id()),
        "prefix-sums",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        .select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
                F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                F.sum("bytes").over(Window.partitionBy()).alias("total"))
    )  # one row per partition of the exchange above
    return numbered.join(F.broadcast(offsets), "part").select(
        *plain, (F.col("row") + F.col("rows_before")).alias("row"),
        (F.col("before") + F.col("bytes_before")).alias("before"), "total")


def shard_by_bytes(documents: DataFrame, shards: int, keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, shard (contiguous in the global order, bytes near equal) and slot (gapless from 0)."""
    keep = ["doc_id"] if keep is None else keep
    placed = prefix_sums(documents, keep).withColumn(
        "shard", F.least(F.expr(f"({shards} * (2 * before + size)) div (2 * total)"), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        *keep, "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
