"""Row counts and ends of a column from the footers of Parquet files, without reading rows.

Spark answers min, max and count from the footers when Parquet is read through its v2 reader with aggregate push-down on. Both
are session settings, so they are set in a session of their own. The result is a handful of numbers on the driver. Files
whose footers lack them (or keep timestamps in another unit than microseconds) are scanned for that column.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Ends:
    rows: int
    first: object
    last: object


def _bounds(spark: SparkSession, path: str, column: str) -> tuple[DataFrame, T.DataType]:
    """One row (rows, first, last), and the column's type. Footers give no ends of timestamps, which are whole
    microseconds in the file and are asked for as such."""
    session = spark.newSession()
    for name, value in SETTINGS.items():
        session.conf.set(name, value)
    schema = session.read.parquet(path).schema  # all columns in their places: push-down finds a column by its place
    kind = schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        schema = T.StructType([T.StructField(f.name, T.LongType()) if f.name == column else f for f in schema])
    return _summary(session.read.schema(schema).parquet(path), column), kind


def _summary(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.count("*").alias("rows"), F.min(column).alias("first"), F.max(column).alias("last"))


def column_ends(spark: SparkSession, path: str, column: str) -> Ends:
    """Rows of the files and the least and the largest value of ``column``; None where there is none."""
    df, kind = _bounds(spark, path, column)
    try:
        (row,) = df.collect()
    except (PySparkException, Py4JJavaError):  # no such numbers in the footers
        return Ends(*_summary(spark.read.parquet(path), column).first())

    def value(v):
        if v is None or not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return v
        moment = EPOCH + timedelta(microseconds=v)
        return moment if isinstance(kind, T.TimestampNTZType) else moment.replace(tzinfo=timezone.utc)

    return Ends(row.rows or 0, value(row.first), value(row.last))  # no files, no counts to add up


def profile_files(spark: SparkSession, paths: dict[str, str], column: str = "date") -> DataFrame:
    """Row count, first and last day of each stored table."""
    found = {name: column_ends(spark, path, column) for name, path in paths.items()}
    rows = [(name, e.rows, _day(e.first), _day(e.last)) for name, e in found.items()]
    return spark.createDataFrame(rows, "table_name STRING, rows BIGINT, first_day DATE, last_day DATE")


def _day(value) -> date | None:
    return value.date() if isinstance(value, datetime) else value
