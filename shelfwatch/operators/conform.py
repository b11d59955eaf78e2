"""Conformed daily tables and dimensions, from the typed raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.dates import date_key
from shelfwatch.params import Params

# The holiday types that close or change a trading day nationally.
NATIONAL_TYPES = ["Holiday", "Transfer", "Additional", "Bridge"]

MOST_DAYS = 100 * 366  # that a calendar may span


def sales_daily(train: DataFrame, p: Params) -> DataFrame:
    """One row per store, item and day, with returns kept apart from units sold.

    ``on_promo`` is NULL only when every row of the day has an unknown flag. Partial aggregation
    collapses hot keys on the map side.
    """
    return (
        train.filter(F.col("date") >= F.lit(p.slice_start))
        .groupBy("date", "store_nbr", "item_nbr")
        .agg(
            F.sum(F.greatest("unit_sales", F.lit(0.0))).alias("units"),
            F.sum(F.greatest(-F.col("unit_sales"), F.lit(0.0))).alias("return_units"),
            F.bool_or("onpromotion").alias("on_promo"),
        )
    )


def store_day(transactions: DataFrame, p: Params) -> DataFrame:
    """Receipts per store and day from the start of the slice."""
    return transactions.filter(F.col("date") >= F.lit(p.slice_start)).select(
        "date", "store_nbr", F.col("transactions").alias("receipts")
    )


def national_holidays(holidays_events: DataFrame) -> DataFrame:
    """Days that are a national holiday as observed. A transferred holiday counts on its new day only."""
    return (
        holidays_events
        .filter((F.col("locale") == "National") & F.col("type").isin(NATIONAL_TYPES) & ~F.col("transferred"))
        .select("date")
        .distinct()
    )


def dim_date(sales: DataFrame, store_days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last day seen in either table."""
    edges = sales.select("date").unionByName(store_days.select("date")).agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    # one wrong date far off would make a calendar that cannot be sent out
    span = F.datediff("last", "first")
    last = F.when(span > MOST_DAYS, F.raise_error(F.lit(f"the dates span more than {MOST_DAYS} days"))).otherwise(F.col("last"))
    days = edges.filter(F.col("first").isNotNull()).select(F.explode(F.sequence("first", last)).alias("date"))
    holiday = holidays.select("date", F.lit(True).alias("holiday"))
    weekday = F.weekday("date") + 1
    return (
        # both sides hold at most one row per calendar day, so the copy sent out is small by nature
        days.join(F.broadcast(holiday), "date", "left")
        .select(
            date_key("date").alias("date_key"),
            "date",
            F.year("date").alias("year"),
            F.quarter("date").alias("quarter"),
            F.month("date").alias("month_num"),
            F.date_format("date", "MMM").alias("month_name"),
            (F.year("date") * 100 + F.month("date")).alias("month_key"),
            F.weekofyear("date").alias("iso_week"),
            # a week belongs to the year of its Thursday
            F.year(F.date_add(F.date_sub("date", F.weekday("date")), 3)).alias("iso_year"),
            weekday.alias("weekday_num"),
            F.date_format("date", "EEE").alias("weekday_name"),
            (weekday >= 6).alias("is_weekend"),
            F.coalesce("holiday", F.lit(False)).alias("is_national_holiday"),
        )
    )


def dim_store(stores: DataFrame, transactions: DataFrame) -> DataFrame:
    """Stores that have traded. ``opening_date`` is the first receipt, or NULL when that falls within a
    week of the first day of the data, because the store may have been open before.

    Uses the whole history, not the slice.
    """
    first_receipt = transactions.groupBy("store_nbr").agg(F.min("date").alias("first_receipt"))
    data_start = first_receipt.agg(F.min("first_receipt"))  # one row
    known = F.col("first_receipt") > F.date_add(data_start.scalar(), 7)
    return stores.join(first_receipt, "store_nbr").select(
        F.col("store_nbr").alias("store_key"), "store_nbr", "city", "state",
        F.col("type").alias("store_type"), "cluster",
        F.when(known, F.col("first_receipt")).alias("opening_date"),
    )


def dim_item(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("item_nbr").alias("item_key"), "item_nbr", "family", "class",
        (F.col("perishable") == 1).alias("is_perishable"),
    )


def contract_store_day(store_days: DataFrame) -> DataFrame:
    return store_days.select(date_key("date").alias("date_key"), F.col("store_nbr").alias("store_key"), "receipts")
