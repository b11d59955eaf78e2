"""Tables written to the run's shared folder and read back.

An intermediate that several branches read is written once as Parquet: branches cannot disagree, a lost executor
costs a re-read instead of a recomputation, and later scans prune columns and push filters into the file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; where that is unset, below the warehouse, the other
    folder that driver and executors share. Hadoop removes it when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/shelfwatch-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and go on from the written copy."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """As ``store``, with the rows of each value of ``column`` in one of ``buckets`` files, so that grouping and joining by
    it needs no exchange. The catalog needs a table for that while the result is analysed; it is dropped at once, its files
    stay."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    (df.repartition(buckets, column).write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}")
     .bucketBy(buckets, column).saveAsTable(table))
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return written


def _folder(spark: SparkSession, path: str):
    """The file system and the qualified path."""
    plain = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(plain)


def _before(path):
    """Where a folder waits while its successor takes its place."""
    return path.suffix(".before")


def replace_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Put the finished folder ``staged`` in the place of ``path``. The old one is deleted last; until then
    ``recover_folder`` can bring it back."""
    files, target = _folder(spark, path)
    recover_folder(spark, path)
    if files.exists(target):
        files.rename(target, _before(target))
    files.rename(_folder(spark, staged)[1], target)
    files.delete(_before(target), True)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Bring back the old folder where a replacement stopped between its two renames."""
    files, target = _folder(spark, path)
    if files.exists(_before(target)):
        if files.exists(target):
            files.delete(_before(target), True)
        else:
            files.rename(_before(target), target)
