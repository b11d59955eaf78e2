"""Typed reading of the five raw CSV files, and the date slice that is cut from them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The columns and types of the raw files.
RAW_SCHEMAS = {
    "train": "id BIGINT, date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion BOOLEAN",
    "transactions": "date DATE, store_nbr INT, transactions INT",
    "stores": "store_nbr INT, city STRING, state STRING, type STRING, cluster INT",
    "items": "item_nbr INT, family STRING, class INT, perishable INT",
    "holidays_events": (
        "date DATE, type STRING, locale STRING, locale_name STRING, description STRING, transferred BOOLEAN"
    ),
}


def read_raw(spark: SparkSession, path: str, name: str, *, spread: int | None = None) -> DataFrame:
    """Read one raw file (or folder of files) with its fixed schema. A malformed row fails the read.

    A gzip file cannot be split, so each one arrives as a single partition; ``spread`` redistributes
    the rows before the first wide step when there are fewer files than cores.
    """
    df = spark.read.schema(RAW_SCHEMAS[name]).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.repartition(spread) if spread else df


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while they are written, instead of scanning the written table again."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def slice_rows(raw: DataFrame, name: str, start: date, end: date) -> DataFrame:
    """Sales rows dated within [start, end]; every other file is kept whole."""
    if name != "train":
        return raw
    return raw.filter(F.col("date").cast("date").between(F.lit(start), F.lit(end)))


def slice_raw(spark: SparkSession, source: str, target: str, start: date, end: date) -> dict[str, int]:
    """Cut the raw CSV files to the analysis slice as gzip CSV folders; returns rows written per file.

    All columns are read as text and written back as they were. Output keeps one part per input
    split, so the slice of a large file stays readable in parallel.
    """
    counts = {}
    for name in RAW_SCHEMAS:
        text = spark.read.option("header", True).option("escape", '"').csv(f"{source}/{name}.csv")
        rows, seen = counted(slice_rows(text, name, start, end), f"slice_{name}")
        (
            rows.write.mode("overwrite")
            .option("header", True).option("escape", '"').option("compression", "gzip")
            .option("zlib.compress.level", "BEST_SPEED")  # a slice is read back at once
            .csv(f"{target}/{name}.csv.gz")
        )
        counts[name] = seen.get["rows"]
    return counts


def slice_counts(raw: Mapping[str, DataFrame], start: date, end: date) -> DataFrame:
    """Rows each file keeps in the slice, as one table."""
    parts = [
        slice_rows(df, name, start, end).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in raw.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
