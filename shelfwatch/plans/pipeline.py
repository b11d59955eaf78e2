"""A full run: typed tables, silver, gold, checks, export. Every table is a full refresh."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.functions.stored import recover_folder, replace_folder
from shelfwatch.operators.quality import dq_checks, require_clean
from shelfwatch.params import Params
from shelfwatch.plans.layers import EXPORTED, GOLD, SILVER, Layers
from shelfwatch.plans.publish import Shelf, run_stamp
from shelfwatch.sources.raw import RAW_SCHEMAS, counted, read_raw
from shelfwatch.sources.splits import partitions_of

CHECKED = ["sales", "fact_sales", "fact_stockout_risk", "stg_store", "stg_item", "dim_date"]

# Tables read in store-item windows again and again: their keys, and the day that orders a store-item.
BY_STORE_ITEM = {
    "sales": (["store_nbr", "item_nbr"], "date"),
    "stockout_series": (["store_nbr", "item_nbr"], "date"),
    "fact_sales": (["store_key", "item_key"], "date_key"),
}


class Store(ABC):
    """Where tables are written and read back."""

    writes = True  # saving a table runs a job

    @abstractmethod
    def save(self, layer: str, name: str, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def table(self, layer: str, name: str) -> DataFrame: ...


class FolderStore(Store):
    """Parquet folders ``root/layer/name``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        """Write beside the table and swap the folders: a job that dies leaves the old table, and a table may be made from
        itself."""
        staged = f"{self.root}/{layer}/.{name}-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        replace_folder(self.spark, staged, f"{self.root}/{layer}/{name}")
        return self.table(layer, name)

    def table(self, layer: str, name: str) -> DataFrame:
        recover_folder(self.spark, f"{self.root}/{layer}/{name}")
        return self.spark.read.parquet(f"{self.root}/{layer}/{name}")


class CatalogStore(Store):
    """Tables ``layer.name`` in the session catalog.

    Tables keyed by store-item are bucketed and sorted on those keys, so the windows, island numbering
    and groupings that follow read them without an exchange. ``sales`` is exchanged once, when it is
    written; the larger tables made from it are computed and written bucket by bucket. ``buckets``
    should give each bucket a few hundred megabytes; one store-item is at most one row per calendar
    day, so buckets stay even. ``prefix`` goes before the schema names, so that several sets of tables can lie in one
    catalog; ``root`` is the folder of the schemas, by default in the warehouse.
    """

    def __init__(self, spark: SparkSession, buckets: int, prefix: str = "", root: str | None = None):
        self.spark, self.buckets, self.prefix, self.root = spark, buckets, prefix, root

    def save(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        place = f" LOCATION '{self.root}/{layer}'" if self.root else ""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.prefix}{layer}{place}")
        writer = df.write.mode("overwrite").format("parquet")
        if name in BY_STORE_ITEM:
            keys, day = BY_STORE_ITEM[name]
            if name == "sales":
                writer = df.repartition(self.buckets, *keys).write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(self.buckets, *keys).sortBy(*keys, day)
        writer.saveAsTable(f"{self.prefix}{layer}.{name}")
        return self.table(layer, name)

    def table(self, layer: str, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}{layer}.{name}")


class ViewStore(Store):
    """Temporary views ``layer__name``: nothing is written and every read recomputes its plan."""

    writes = False

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def save(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(f"{layer}__{name}")
        return df

    def table(self, layer: str, name: str) -> DataFrame:
        return self.spark.table(f"{layer}__{name}")


def load_raw(
    spark: SparkSession, store: Store, folder: str, extension: str = ".csv.gz", spread: int | None = None
) -> dict[str, int]:
    """Read the five raw files with their fixed types into the bronze layer; returns rows per table.

    Rows are counted while they are written, not by a second scan. The sales are dealt to ``spread`` partitions; by default
    to as many as their bytes deserve, where they arrive as fewer gzip files.
    """
    counts = {}
    for name in RAW_SCHEMAS:
        path = f"{folder}/{name}{extension}"
        df = read_raw(spark, path, name, spread=(spread or partitions_of(spark, path)) if name == "train" else None)
        if store.writes:
            df, seen = counted(df, f"load_{name}")
            store.save("bronze", name, df)
            counts[name] = seen.get["rows"]
        else:
            counts[name] = store.save("bronze", name, df).count()
    return counts


def counts_table(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Row counts as a table, to keep beside the data."""
    return spark.createDataFrame(sorted(counts.items()), "table_name STRING, rows BIGINT")


def build(store: Store, p: Params) -> Layers:
    """Write every silver and gold table from the bronze ones, each from the written tables before it."""
    tables = Layers({name: store.table("bronze", name) for name in RAW_SCHEMAS}, p, keep=store.save)
    tables.tables(SILVER + GOLD)
    return tables


def export(tables: Layers, target: str, stamp: datetime | None = None) -> str:
    """Publish the consumer tables as one release, after all data checks pass; nothing is written otherwise. ``stamp``: when
    the run started."""
    require_clean(dq_checks(tables.tables(CHECKED)))
    tables = tables.tables(EXPORTED)
    return Shelf(tables[EXPORTED[0]].sparkSession, target).publish(tables, stamp)


def run(spark: SparkSession, store: Store, raw_folder: str, target: str, p: Params, extension: str = ".csv.gz",
        spread: int | None = None) -> Layers:
    stamp = run_stamp()
    load_raw(spark, store, raw_folder, extension, spread)
    tables = build(store, p)
    export(tables, target, stamp)
    return tables
