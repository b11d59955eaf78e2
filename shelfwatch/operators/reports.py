"""Report-ready tables: monthly roll-up, layer profile and the data behind the five charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.ranking import medians, quantile, rank_index

HISTOGRAM_BINS = 60


def _percent(c: Column) -> Column:
    return F.round(F.round(c * 100, 10), 2)


def stockout_month(risk: DataFrame, dates: DataFrame) -> DataFrame:
    """Flagged days and estimated lost units per month. Summed as DECIMAL: whether a total rounds up or
    down must not depend on the order of addition."""
    lost = F.sum(F.col("expected_units").cast("decimal(38,6)"))
    return (
        risk.join(F.broadcast(dates.select("date_key", "year", "month_num")), "date_key")
        .groupBy("year", "month_num")
        .agg(F.count("*").alias("flagged_days"), F.round(lost).cast("double").alias("est_lost_units"))
        .orderBy("year", "month_num")
    )


def layer_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, first and last day of each table that has a date column."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
        .select(F.lit(name).alias("table_name"), "rows", "first_day", "last_day")
        for name, df in tables.items()
    ])


def uplift_ranking(summary: DataFrame) -> DataFrame:
    """Median uplift per family in percent with the two error-bar lengths, best family first."""
    mid = F.col("uplift_median")
    best = summary.agg(F.max(F.struct(mid, "family"))["family"]).scalar()  # of equal ones the last by name
    return summary.select(
        "family", "n_events",
        _percent(mid).alias("uplift_pct"),
        _percent(F.col("uplift_hi") - mid).alias("error_up_pct"),
        _percent(mid - F.col("uplift_lo")).alias("error_down_pct"),
        (F.col("family") == best).alias("is_top"),
    ).orderBy(F.desc("uplift_pct"), "family")


def payback_class(summary: DataFrame) -> DataFrame:
    """Whether promotions pay back per family: the net-lift interval lies above 0, below 0, or spans it."""
    mid = F.col("net_median")
    return summary.filter(mid.isNotNull()).select(
        "family", "n_net_events",
        _percent(mid).alias("net_pct"),
        _percent(F.col("net_hi") - mid).alias("error_up_pct"),
        _percent(mid - F.col("net_lo")).alias("error_down_pct"),
        _percent(F.col("uplift_median")).alias("uplift_pct"),
        _percent(F.col("dip_median")).alias("dip_pct"),
        F.when(F.col("net_lo") > 0, "pays").when(F.col("net_hi") < 0, "loses").otherwise("unclear").alias("payback"),
    ).orderBy("net_pct", "family")


def payback_count(summary: DataFrame) -> DataFrame:
    """One row: families that pay back, and families with a net lift."""
    return payback_class(summary).agg(
        F.count_if(F.col("payback") == "pays").alias("paying"), F.count("*").alias("families"))


def payday_gap(events: DataFrame, min_events: int) -> DataFrame:
    """Median uplift of events that touch a payday or holiday against the rest, per family. Both groups of
    a family need at least ``min_events`` events."""
    groups = ["family", "touches_payday_or_holiday"]
    known = events.filter(F.col("family").isNotNull() & F.col("touches_payday_or_holiday").isNotNull())
    typical = medians(rank_index(known, groups, "uplift"), min_events)
    return (
        typical.groupBy("family")
        .pivot("touches_payday_or_holiday", [False, True]).agg(F.max("median"))
        .withColumnsRenamed({"false": "other", "true": "touching"})
        .dropna(subset=["other", "touching"])
        .select("family", _percent(F.col("other")).alias("other_pct"), _percent(F.col("touching")).alias("touching_pct"),
                (F.col("touching") - F.col("other")).alias("gap"))
        .orderBy("gap", "family")
    )


def payday_headline(gaps: DataFrame) -> DataFrame:
    """One row: families where paydays and holidays raise the uplift, and families compared."""
    return gaps.agg(F.count_if(F.col("gap") > 0).alias("inflated"), F.count("*").alias("families"))


def store_stockout_rank(weekly: DataFrame) -> DataFrame:
    """Stores by share of tested item-days inside a flagged run over the whole window, worst first."""
    return (
        weekly.groupBy("store_key", "city")
        .agg(F.sum("flagged_days").alias("flagged_days"), F.sum("item_days").alias("item_days"))
        .withColumn("rate", F.col("flagged_days") / F.col("item_days"))
        .orderBy(F.desc("rate"), "store_key")
    )


def worst_store(weekly: DataFrame) -> DataFrame:
    """The store that ran empty most often."""
    return store_stockout_rank(weekly).limit(1)


def stockout_grid(weekly: DataFrame) -> DataFrame:
    """Store × week heat-map cells in long form: rate in percent, NULL where the store was not tested.

    Each store lists the weeks between the first and the last one seen; weeks nobody was tested in are
    dropped again. Only equi-joins are involved.
    """
    weeks = weekly.select("week_start").distinct()
    first, last = weeks.agg(F.min("week_start")).scalar(), weeks.agg(F.max("week_start")).scalar()
    return (
        weekly.select("store_key", "city").distinct()
        .withColumn("first", first).withColumn("last", last)
        .select("store_key", "city", F.explode(F.sequence("first", "last", F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
        .join(weeks, "week_start", "left_semi")
        .join(weekly.groupBy("store_key", "week_start").agg(F.sum("rate").alias("rate")), ["store_key", "week_start"], "left")
        .select("store_key", "city", "week_start", F.round(F.col("rate") * 100, 4).alias("rate_pct"))
    )


def stockout_grid_cap(weekly: DataFrame) -> DataFrame:
    """The 95th percentile of the heat-map cells: the top of its colour scale."""
    cells = weekly.groupBy("store_key", "week_start").agg(F.round(F.sum("rate") * 100, 4).alias("rate_pct"))
    index = rank_index(cells.withColumn("grid", F.lit(1)), ["grid"], "rate_pct")
    return quantile(index, 0.95, "cap_pct").select("cap_pct")


def dispersion_headline(dispersion: DataFrame) -> DataFrame:
    """One row: exact median dispersion and the share of store-items above 1. One pass over the input."""
    index = rank_index(dispersion.withColumn("all", F.lit(1)), ["all"], "dispersion")
    above = F.sum(F.when(F.col("value") > 1, F.col("ties")).otherwise(0))
    share = index.known.agg((above / F.sum("ties")).alias("share_over_1"))
    median = medians(index).select("median")
    return share.select(median.scalar().alias("median_dispersion"), "share_over_1")


def overdispersed_share(dispersion: DataFrame) -> DataFrame:
    """Share of store-items with any variation that vary more than a Poisson count would."""
    return dispersion.filter(F.col("dispersion") > 0).agg(
        F.avg((F.col("dispersion") > 1).cast("int")).alias("share_over_1"))


def dispersion_histogram(dispersion: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Store-items per equal-width bin of log10 dispersion; store-items without variation are left out."""
    logs = dispersion.filter(F.col("dispersion") > 0).select(F.log10("dispersion").alias("x"))
    low, high = logs.agg(F.min("x")).scalar(), logs.agg(F.max("x")).scalar()
    # rounded, so that a value on a bin edge does not depend on the last bit of a logarithm
    place = F.floor(F.round((F.col("x") - F.col("low")) / F.col("width"), 6))
    return (
        logs.withColumn("low", low).withColumn("width", (high - low) / bins)
        .withColumn("bin", F.when(F.col("width") > 0, F.least(place, F.lit(bins - 1))).otherwise(0).cast("int"))
        .groupBy("bin", "low", "width").agg(F.count("*").alias("store_items"))
        .select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from_log10"),
                (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to_log10"), "store_items")
        .orderBy("bin")
    )
