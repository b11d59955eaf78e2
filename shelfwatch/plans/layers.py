"""The tables of the analysis and how they depend on each other.

Each table is defined once, as a lazy DataFrame over earlier ones. ``keep`` decides what happens to a
finished definition: by default nothing (the whole chain stays one lazy plan); a pipeline run writes
the table and hands back the written copy, so later tables start from storage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from shelfwatch.operators import bootstrap, conform, fdr, promo, runs, series
from shelfwatch.params import Params

Keep = Callable[[str, str, DataFrame], DataFrame]

# Build order of the tables in each layer.
SILVER = ["sales", "store_day", "national_holidays", "stockout_series", "stockout_run_tested"]
GOLD = ["dim_date", "stg_store", "stg_item", "stg_store_day", "fact_sales", "fact_stockout_risk",
        "fact_stockout_run", "stockout_bh_summary", "stockout_store_week", "item_dispersion",
        "fact_promo_event", "promo_family_summary"]
# The tables handed to consumers.
EXPORTED = [name for name in GOLD if name != "item_dispersion"]


def _lazy(layer: str, name: str, df: DataFrame) -> DataFrame:
    return df


class Layers:
    def __init__(self, raw: Mapping[str, DataFrame], p: Params, keep: Keep = _lazy):
        self.raw, self.p, self._keep = raw, p, keep

    def tables(self, names: list[str]) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}

    # silver

    @cached_property
    def sales(self) -> DataFrame:
        return self._keep("silver", "sales", conform.sales_daily(self.raw["train"], self.p))

    @cached_property
    def store_day(self) -> DataFrame:
        return self._keep("silver", "store_day", conform.store_day(self.raw["transactions"], self.p))

    @cached_property
    def national_holidays(self) -> DataFrame:
        return self._keep("silver", "national_holidays", conform.national_holidays(self.raw["holidays_events"]))

    @cached_property
    def stockout_series(self) -> DataFrame:
        return self._keep("silver", "stockout_series", series.stockout_series(self.sales, self.store_day, self.p))

    @cached_property
    def stockout_run_tested(self) -> DataFrame:
        return self._keep("silver", "stockout_run_tested", runs.stockout_runs(self.stockout_series, self.p))

    # gold

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._keep("gold", "dim_date", conform.dim_date(self.sales, self.store_day, self.national_holidays))

    @cached_property
    def stg_store(self) -> DataFrame:
        return self._keep("gold", "stg_store", conform.dim_store(self.raw["stores"], self.raw["transactions"]))

    @cached_property
    def stg_item(self) -> DataFrame:
        return self._keep("gold", "stg_item", conform.dim_item(self.raw["items"]))

    @cached_property
    def stg_store_day(self) -> DataFrame:
        return self._keep("gold", "stg_store_day", conform.contract_store_day(self.store_day))

    @cached_property
    def fact_sales(self) -> DataFrame:
        return self._keep("gold", "fact_sales", promo.promo_baseline(self.sales, self.store_day, self.p))

    @cached_property
    def fact_stockout_risk(self) -> DataFrame:
        return self._keep("gold", "fact_stockout_risk", series.stockout_risk_days(self.stockout_series, self.p))

    @cached_property
    def fact_stockout_run(self) -> DataFrame:
        flagged, _ = fdr.flag_bh(self.stockout_run_tested, self.p.fdr_q)
        return self._keep("gold", "fact_stockout_run", flagged)

    @cached_property
    def stockout_bh_summary(self) -> DataFrame:
        return self._keep("gold", "stockout_bh_summary", fdr.bh_summary(self.stockout_run_tested, self.p.fdr_q))

    @cached_property
    def stockout_store_week(self) -> DataFrame:
        weekly = runs.weekly_stockout_rate(self.fact_stockout_run, self.stockout_series, self.stg_store, self.p)
        return self._keep("gold", "stockout_store_week", weekly)

    @cached_property
    def item_dispersion(self) -> DataFrame:
        return self._keep("gold", "item_dispersion", runs.item_dispersion(self.stockout_series, self.p))

    @cached_property
    def fact_promo_event(self) -> DataFrame:
        events = promo.promo_events(self.fact_sales, self.dim_date, self.stg_item, self.stg_store_day, self.p)
        return self._keep("gold", "fact_promo_event", events)

    @cached_property
    def promo_family_summary(self) -> DataFrame:
        return self._keep("gold", "promo_family_summary", bootstrap.family_summary(self.fact_promo_event, self.p))
