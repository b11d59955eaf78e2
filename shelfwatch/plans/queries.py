"""Every operator as a named query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions.stored import store
from shelfwatch.functions.workers import importable
from shelfwatch.operators import bootstrap, fdr, promo, quality, reconcile, reports, runs, series
from shelfwatch.params import Params
from shelfwatch.plans import files
from shelfwatch.plans.layers import Layers
from shelfwatch.sources.raw import slice_counts
from shelfwatch.sources.star_schema import Grain, StarSchemaTables

PARAMS = Params(slice_start=date(1995, 1, 2), window_start=date(1996, 9, 1), window_end=date(2000, 12, 31))
# The same analysis started from a slice with a burn-in of half a lookback, too short for the first
# baselines and histories: the two producers differ, and in one direction only.
SLICED = replace(PARAMS, slice_start=PARAMS.window_start - timedelta(days=PARAMS.lookback_days // 2))

DECIMALS = 6
TIE_SHIFT = 1e-10


def comparable(df: DataFrame) -> DataFrame:
    """One representation per kind of value, so results compare across engines: whole numbers as BIGINT,
    dates as ISO text, doubles rounded."""

    def cast(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.FractionalType):
            # engines break decimal ties differently: move them off the tie; + 0.0 turns -0.0 into 0.0
            c = F.round(c.cast("double") + TIE_SHIFT, DECIMALS) + F.lit(0.0)
        return c.alias(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])


# Tables that several later ones read; written once, as a pipeline run would.
SHARED = frozenset({"sales", "store_day", "stockout_run_tested"})
# Queries that read the daily tables once: these stay part of one plan.
READ_ONCE = frozenset({
    "sales_daily", "store_day", "contract_store_day", "eligible_pairs", "trading_spine", "full_trading_days", "stockout_series",
    "stockout_risk_days", "zero_sale_runs", "stockout_runs_flagged", "bh_summary", "item_dispersion", "dispersion_headline",
    "dispersion_histogram", "overdispersed_share", "promo_baseline", "nation_runs_flagged", "nation_bh_summary",
})


def layers(
    spark: SparkSession, folder: str, p: Params = PARAMS, grain: Grain = Grain(), shared: frozenset[str] = SHARED
) -> Layers:
    def keep(layer: str, name: str, df: DataFrame) -> DataFrame:
        return store(df, name) if name in shared else df

    return Layers(StarSchemaTables(spark, folder, grain), p, keep=keep)


def _reconcile_inputs(spark: SparkSession, folder: str):
    new, old = layers(spark, folder, SLICED), layers(spark, folder)
    return new, old, PARAMS.window_start, PARAMS.window_end


def _reconcile_sales(spark, folder):
    new, old, start, end = _reconcile_inputs(spark, folder)
    return reconcile.sales_totals(new.fact_sales, old.fact_sales, start, end)


def _reconcile_baselines(spark, folder):
    new, old, start, end = _reconcile_inputs(spark, folder)
    return reconcile.baseline_agreement(new.fact_sales, old.fact_sales, start, end)


def _reconcile_flags(spark, folder):
    new, old, start, end = _reconcile_inputs(spark, folder)
    return reconcile.flag_agreement(new.fact_stockout_risk, old.fact_stockout_risk, start, end, PARAMS.min_expected_units)


def _reconcile_report(spark, folder):
    new, old, start, end = _reconcile_inputs(spark, folder)
    return reconcile.reconcile(new.fact_sales, new.fact_stockout_risk, old.fact_sales, old.fact_stockout_risk,
                               start, end, PARAMS.min_expected_units)


CHECKED = ["sales", "fact_sales", "fact_stockout_risk", "stg_store", "stg_item", "dim_date"]
# What the seeded checks lack: one store and every fourth item.
MISSING_STORE, MISSING_ITEMS = 2, 4


def _seeded(t: Layers) -> dict[str, DataFrame]:
    tables = t.tables(CHECKED)
    return {**tables, "stg_store": tables["stg_store"].filter(F.col("store_key") != MISSING_STORE),
            "stg_item": tables["stg_item"].filter(F.col("item_key") % MISSING_ITEMS != 0)}


def _exact_weeks(t: Layers) -> DataFrame:
    flagged, _ = fdr.flag_bh(store(runs.stockout_runs(t.stockout_series, t.p, keep_days=True), "stockout_run_days"), t.p.fdr_q)
    calendar = series.trading_bits(t.store_day, t.p)
    return runs.weekly_stockout_rate(flagged, t.stockout_series, t.stg_store, t.p, credit="own", calendar=calendar)


def _order_summary(t: Layers) -> DataFrame:
    return bootstrap.family_summary(t.fact_promo_event, t.p, interval="order")


# Days watched after a promotion of a family with perishable items, and of others.
PERISHABLE_DAYS, DURABLE_DAYS = 3, 14


def _family_windows(t: Layers) -> DataFrame:
    days = F.when(F.max(F.col("is_perishable").cast("int")) == 1, PERISHABLE_DAYS).otherwise(DURABLE_DAYS)
    return t.stg_item.groupBy("family").agg(days.alias("post_days"))


PROFILED = ["sales", "store_day", "stockout_series"]

# name -> result of the query, given the tables
_ON_LAYERS: dict[str, Callable[[Layers], DataFrame]] = {
    # conformed tables and dimensions
    "sales_daily": lambda t: t.sales,
    "store_day": lambda t: t.store_day,
    "national_holidays": lambda t: t.national_holidays,
    "dim_date": lambda t: t.dim_date,
    "dim_item": lambda t: t.stg_item,
    "contract_store_day": lambda t: t.stg_store_day,
    # series and the single-day rule
    "eligible_pairs": lambda t: series.eligible_pairs(t.sales, t.p),
    "trading_spine": lambda t: series.trading_spine(t.sales, t.store_day, t.p),
    "full_trading_days": lambda t: series.full_trading_days(t.store_day, t.p),
    "stockout_series": lambda t: t.stockout_series,
    "stockout_risk_days": lambda t: t.fact_stockout_risk,
    # runs and false-discovery control
    "zero_sale_runs": lambda t: runs.zero_sale_runs(t.stockout_series).drop("run_id", "full_days"),
    "stockout_runs_tested": lambda t: t.stockout_run_tested,
    "stockout_runs_flagged": lambda t: t.fact_stockout_run,
    "bh_summary": lambda t: t.stockout_bh_summary,
    "item_dispersion": lambda t: t.item_dispersion,
    "dispersion_headline": lambda t: reports.dispersion_headline(t.item_dispersion),
    "stockout_store_week": lambda t: t.stockout_store_week,
    "stockout_store_week_exact": _exact_weeks,
    # promotions
    "promo_baseline": lambda t: t.fact_sales,
    "promo_events_raw": lambda t: promo.promo_events_raw(t.fact_sales, t.dim_date, t.p).drop("event_id"),
    "promo_post_window": lambda t: promo.promo_post_window(
        t.fact_sales, t.dim_date, t.stg_store_day, t.p).drop("event_id"),
    "promo_post_by_family": lambda t: promo.promo_post_by_family(
        t.fact_sales, t.dim_date, t.stg_store_day, t.stg_item, _family_windows(t), t.p).drop("event_id"),
    "promo_events": lambda t: t.fact_promo_event,
    "promo_family_medians": lambda t: bootstrap.family_medians(t.fact_promo_event, t.p),
    "promo_family_summary": lambda t: t.promo_family_summary,
    "interval_brackets": lambda t: bootstrap.interval_brackets(t.fact_promo_event, t.p),
    "interval_bounds": lambda t: bootstrap.interval_bounds(t.fact_promo_event, t.p),
    # the same summary and its reports with intervals that need no draws
    "family_summary_order": _order_summary,
    "uplift_ranking_order": lambda t: reports.uplift_ranking(_order_summary(t)),
    "payback_class_order": lambda t: reports.payback_class(_order_summary(t)),
    "payback_count_order": lambda t: reports.payback_count(_order_summary(t)),
    # checks
    "slice_counts": lambda t: slice_counts(t.raw, SLICED.slice_start, t.p.window_end),
    "dq_checks": lambda t: quality.dq_checks(t.tables(CHECKED)),
    "dq_seeded": lambda t: quality.failing(quality.dq_checks(_seeded(t))),
    "dq_failing": lambda t: quality.failing(quality.dq_checks(t.tables(CHECKED))),
    # reports
    "stockout_month": lambda t: reports.stockout_month(t.fact_stockout_risk, t.dim_date),
    "layer_profile": lambda t: reports.layer_profile(t.tables(PROFILED)),
    "uplift_ranking": lambda t: reports.uplift_ranking(t.promo_family_summary),
    "payback_class": lambda t: reports.payback_class(t.promo_family_summary),
    "payback_count": lambda t: reports.payback_count(t.promo_family_summary),
    "payday_gap": lambda t: reports.payday_gap(t.fact_promo_event, t.p.min_family_events),
    "payday_headline": lambda t: reports.payday_headline(
        reports.payday_gap(t.fact_promo_event, t.p.min_family_events)),
    "store_stockout_rank": lambda t: reports.store_stockout_rank(t.stockout_store_week),
    "worst_store": lambda t: reports.worst_store(t.stockout_store_week),
    "stockout_grid": lambda t: reports.stockout_grid(t.stockout_store_week),
    "stockout_grid_cap": lambda t: reports.stockout_grid_cap(t.stockout_store_week),
    "dispersion_histogram": lambda t: reports.dispersion_histogram(t.item_dispersion),
    "overdispersed_share": lambda t: reports.overdispersed_share(t.item_dispersion),
}

# The same at a finer grain of stores: more, sparser series, of whose runs only a part is flagged.
_ON_NATIONS: dict[str, Callable[[Layers], DataFrame]] = {
    "nation_runs_flagged": _ON_LAYERS["stockout_runs_flagged"],
    "nation_bh_summary": _ON_LAYERS["bh_summary"],
    "nation_store_week": _ON_LAYERS["stockout_store_week"],
    "nation_promo_events": _ON_LAYERS["promo_events"],
}

# Suppliers as stores: some of them open after the data begins.
_ON_SUPPLIERS: dict[str, Callable[[Layers], DataFrame]] = {"dim_store": lambda t: t.stg_store}

_RECONCILE = {
    "reconcile_sales": _reconcile_sales,
    "reconcile_baselines": _reconcile_baselines,
    "reconcile_flags": _reconcile_flags,
    "reconcile_report": _reconcile_report,
}


# Runs over files and views of the raw tables.
_ON_RAW: dict[str, Callable[[SparkSession, StarSchemaTables, Params], DataFrame]] = {
    "csv_load_counts": files.load_counts,
    "csv_loaded_sales": files.loaded_sales,
    "csv_exported_runs": files.exported_runs,
    "release_audit": files.release_audit,
    "sales_by_sql": files.sales_by_sql,
    "catalog_runs_tested": files.catalog_runs,
    "catalog_promo_days": files.catalog_promo_days,
    "stored_profile": files.stored_profile,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_layers(name, build, grain=Grain()):
        shared = SHARED - {"sales", "store_day"} if name in READ_ONCE else SHARED

        def run(spark, folder):
            importable(spark)
            return comparable(build(layers(spark, folder, grain=grain, shared=shared)))

        return run

    def on_raw(build):
        def run(spark, folder):
            importable(spark)
            return comparable(build(spark, StarSchemaTables(spark, folder), PARAMS))

        return run

    def on_folder(build):
        return lambda spark, folder: comparable(build(spark, folder))

    return {**{name: on_layers(name, b) for name, b in _ON_LAYERS.items()},
            **{name: on_layers(name, b, Grain("nation")) for name, b in _ON_NATIONS.items()},
            **{name: on_layers(name, b, Grain("supplier")) for name, b in _ON_SUPPLIERS.items()},
            **{name: on_raw(b) for name, b in _ON_RAW.items()},
            **{name: on_folder(b) for name, b in _RECONCILE.items()}}
