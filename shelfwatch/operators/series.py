"""The daily series of each store-item on its store's trading days, and the single-day rule.

After the daily roll-up a store-item holds at most one row per calendar day and a store at most one
row per calendar day. Windows partitioned by either are therefore bounded by the length of the
calendar, whatever the sales volume behind a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.dates import date_key
from shelfwatch.functions.daybits import DayBits, day_bits
from shelfwatch.params import Params

PAIR = ["store_nbr", "item_nbr"]


def _history_start(p: Params):
    """First day that can influence a result: two lookbacks before the analysis window."""
    return F.date_sub(F.lit(p.window_start), 2 * p.lookback_days)


def _sold_enough(sold: Column, p: Params) -> Column:
    """Whether a store-item could ever reach the rate threshold. Rounded: the order of addition must not decide."""
    return F.round(sold, 6) >= p.min_expected_units * p.lookback_days


def eligible_pairs(sales: DataFrame, p: Params) -> DataFrame:
    """Store-items that sold enough to ever reach the rate threshold, with their first and last sale."""
    return (
        sales.filter(F.col("date") >= _history_start(p))
        .groupBy(*PAIR)
        .agg(F.min("date").alias("first_sale"), F.max("date").alias("last_sale"), F.sum("units").alias("sold"))
        .filter(_sold_enough(F.col("sold"), p))
        .drop("sold")
    )


def store_calendar(store_days: DataFrame, p: Params) -> DataFrame:
    """Trading days (receipts > 0) of each store, judged by the previous calendar days.

    ``full_day``: receipts reach the given share of their mean over those days; NULL where none of
    them was a trading day. ``trading_days``: how many of them were. One window serves both.
    """
    before = Window.partitionBy("store_nbr").orderBy(F.unix_date("date")).rangeBetween(-p.lookback_days, -1)
    usual = F.avg("receipts").over(before)
    return store_days.filter(F.col("receipts") > 0).select(
        "store_nbr", "date",
        (F.col("receipts") >= p.min_receipts_share * usual).alias("full_day"),
        F.count("*").over(before).alias("trading_days"),
    )


def full_trading_days(store_days: DataFrame, p: Params) -> DataFrame:
    """Trading days and whether each was a full one."""
    return store_calendar(store_days, p).drop("trading_days")


def trading_bits(store_days: DataFrame, p: Params) -> DayBits:
    """Each store's calendar as one row: the bitmaps ``trading`` and, judged as in ``store_calendar``, ``full``."""
    return day_bits(store_calendar(store_days, p), "store_nbr", trading=F.lit(True), full=F.col("full_day"))


def _days_of_pairs(sales: DataFrame, bits: DayBits, p: Params) -> DataFrame:
    """Every trading day from first to last sale of each eligible store-item, and whether it was a full one.

    Each sale row carries the silent days up to the next sale, so the panel is filled in place: sales
    rows are exchanged once by store-item and the much larger panel is not exchanged at all. The store's bitmap tells which
    of the days it traded on, so other days are never generated. Totals of
    the store-item come from the same sorted pass; ``centre`` is its typical day, as a whole number.
    """
    in_order = Window.partitionBy(*PAIR).orderBy("date")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    relevant = sales.filter(F.col("date") >= _history_start(p))
    sold_days = (
        relevant.select(*PAIR, F.col("date").alias("sale_date"), "units",
                        F.sum("units").over(whole).alias("sold"),
                        F.round(F.avg("units").over(whole)).alias("centre"),
                        F.lead("date").over(in_order).alias("next_sale"))
        .filter(_sold_enough(F.col("sold"), p))
    )
    sale_day = F.unix_date("sale_date")
    last = F.coalesce(F.unix_date("next_sale") - 1, sale_day)
    days = F.transform(bits.between("trading", sale_day, last), lambda day: F.struct(
        F.date_from_unix_date(day).alias("date"), bits.has("full", day).alias("full_day")))
    return bits.beside(sold_days, PAIR, relevant).select(*PAIR, "sale_date", "units", "centre", F.inline(days))


def trading_spine(sales: DataFrame, store_days: DataFrame, p: Params) -> DataFrame:
    """Store-item × trading day between first and last sale."""
    return _days_of_pairs(sales, trading_bits(store_days, p), p).select(*PAIR, "date")


def stockout_series(sales: DataFrame, store_days: DataFrame, p: Params) -> DataFrame:
    """The spine with zero-filled units and, over the previous ``lookback_days`` trading days, the mean
    rate, sample variance and number of days known."""
    before = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(-p.lookback_days, -1)
    sold_today = F.col("date") == F.col("sale_date")
    off = F.col("units") - F.col("centre")
    n, total, squares = F.col("history_days"), F.col("total"), F.col("squares")
    off_total = total - n * F.col("centre")
    return (
        _days_of_pairs(sales, trading_bits(store_days, p), p)
        .select(*PAIR, "date", "centre",
                F.when(sold_today, F.col("units")).otherwise(0.0).alias("units"),
                (~sold_today).alias("no_sale_row"),
                "full_day")
        # sliding sums are several times cheaper than a sliding var_samp; taken around the typical
        # day they lose no digits
        .withColumns({
            "history_days": F.count("*").over(before),
            "total": F.sum("units").over(before),
            "squares": F.sum(off * off).over(before),
        })
        .select(*PAIR, "date", "units", "no_sale_row", "full_day",
                F.when(n > 0, total / n).alias("lambda_units"),
                F.when(n > 1, F.greatest((n * squares - off_total * off_total) / (n * (n - 1)), F.lit(0.0)))
                .alias("var_units"),
                "history_days")
    )


def stockout_risk_days(series: DataFrame, p: Params) -> DataFrame:
    """Single-day rule: a full trading day without a sale where the usual rate reaches the threshold and
    the item sells again within the lookback. There is no upper date bound."""
    ahead = Window.partitionBy(*PAIR).orderBy(F.unix_date("date")).rangeBetween(1, p.lookback_days)
    resumes = F.max(F.when(F.col("units") > 0, True)).over(ahead)
    return (
        series.withColumn("resumes", resumes)
        .filter(
            (F.col("date") >= F.lit(p.window_start))
            & F.col("full_day") & F.col("no_sale_row")
            & (F.col("history_days") == p.lookback_days)
            # rounded, so that a mean of exactly the threshold does not depend on summation order
            & (F.round("lambda_units", 9) >= p.min_expected_units)
            & F.col("resumes")
        )
        .select(date_key("date").alias("date_key"), F.col("store_nbr").alias("store_key"),
                F.col("item_nbr").alias("item_key"), F.round("lambda_units", 2).alias("expected_units"))
    )
