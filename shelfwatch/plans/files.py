"""Runs over files: the raw tables as CSV, sliced, compressed, loaded with fixed types, built, checked and exported.

Everything lies in a folder of its own below the shared one, so that every executor reaches it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.stored import shared_folder
from shelfwatch.params import Params
from shelfwatch.plans.layers import Layers
from shelfwatch.plans.pipeline import CatalogStore, FolderStore, ViewStore, counts_table, load_raw, run
from shelfwatch.plans.publish import Shelf
from shelfwatch.sources.raw import RAW_SCHEMAS, slice_raw
from shelfwatch.sources.statistics import profile_files


def sliced_files(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> str:
    """Write the raw tables as CSV and cut them to gzip CSV from the slice's start to the window's end; the new root."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for name, schema in RAW_SCHEMAS.items():
        columns = [F.col(c).cast(kind) for c, kind in (field.split() for field in schema.split(", "))]
        raw[name].select(*columns).write.option("header", True).csv(f"{root}/raw/{name}.csv")
    slice_raw(spark, f"{root}/raw", f"{root}/slice", p.slice_start, p.window_end)
    return root


def load_counts(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Rows per table, counted while the sliced files are loaded."""
    root = sliced_files(spark, raw, p)
    return counts_table(spark, load_raw(spark, FolderStore(spark, f"{root}/tables"), f"{root}/slice"))


def loaded_sales(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Daily sales from the loaded files, saved twice over the same table and read back."""
    root = sliced_files(spark, raw, p)
    store = FolderStore(spark, f"{root}/tables")
    load_raw(spark, store, f"{root}/slice")
    tables = Layers({name: store.table("bronze", name) for name in RAW_SCHEMAS}, p)
    store.save("silver", "sales", tables.sales.limit(0))
    return store.save("silver", "sales", tables.sales)


def release_audit(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """The audit of a whole run from files to the export: rows per published table; whether all carry the same stamp, and
    whether they were written after it."""
    root = sliced_files(spark, raw, p)
    run(spark, FolderStore(spark, f"{root}/tables"), f"{root}/slice", f"{root}/export", p)
    audit = Shelf(spark, f"{root}/export").audit()
    only = audit.agg(F.when(F.min("started_at") == F.max("started_at"), F.min("started_at")).alias("stamp")).scalar()
    return audit.select(
        "table_name", "rows", (F.col("started_at") == only).alias("one_stamp"),
        (F.col("written_at") > F.col("started_at")).alias("after_stamp"))


def exported_runs(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """A whole run from files to the export behind the checks; the exported runs of the release that readers see."""
    root = sliced_files(spark, raw, p)
    run(spark, FolderStore(spark, f"{root}/tables"), f"{root}/slice", f"{root}/export", p)
    return Shelf(spark, f"{root}/export").table("fact_stockout_run")


def catalog_tables(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> Layers:
    """Layers over tables of the catalog, in schemas of their own: sales and series bucketed and sorted by store-item."""
    place = uuid.uuid4().hex
    store = CatalogStore(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), prefix=f"run_{place}_",
                         root=f"{shared_folder(spark)}/catalog-{place}")
    kept = {"sales", "store_day", "stockout_series", "fact_sales"}
    return Layers(raw, p, keep=lambda layer, name, df: store.save(layer, name, df) if name in kept else df)


def catalog_runs(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Tested runs from the series scanned as a catalog table."""
    return catalog_tables(spark, raw, p).stockout_run_tested


def catalog_promo_days(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Sales with baselines, read back from their catalog table by SQL."""
    fact = catalog_tables(spark, raw, p).fact_sales
    return fact.filter("on_promo").groupBy("store_key", "item_key").agg(
        F.count("*").alias("promo_days"), F.count("baseline_units").alias("with_baseline"), F.sum("units").alias("promo_units"))


def stored_profile(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Row count, first and last day of stored tables, from the footers of their files."""
    store = FolderStore(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")
    tables = Layers(raw, p, keep=lambda layer, name, df: store.save(layer, name, df) if layer == "silver" else df)
    names = ["sales", "store_day", "stockout_series"]
    tables.tables(names)
    return profile_files(spark, {name: f"{store.root}/silver/{name}" for name in names})


def sales_by_sql(spark: SparkSession, raw: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """SQL with named parameters over temporary views of the layers."""
    store = ViewStore(spark)
    tables = Layers({name: store.save("bronze", name, raw[name]) for name in RAW_SCHEMAS}, p, keep=store.save)
    tables.tables(["sales", "store_day"])
    return spark.sql("""
        SELECT store_nbr, item_nbr, count(*) AS days, round(sum(units), 6) AS units, max(receipts) AS most_receipts
        FROM silver__sales JOIN silver__store_day USING (date, store_nbr)
        WHERE date >= :stockout_from AND receipts > 0
        GROUP BY store_nbr, item_nbr HAVING round(sum(units), 6) >= :min_expected_units * :lookback_days""", args=p.sql_args())
