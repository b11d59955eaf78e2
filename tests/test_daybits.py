import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.functions.daybits import day_bits
from shelfwatch.operators import series
from shelfwatch.operators.fdr import flag_bh
from shelfwatch.operators.promo import promo_baseline, promo_post_window
from shelfwatch.operators.runs import stockout_runs, weekly_stockout_rate, zero_sale_runs

EPOCH = date(1970, 1, 1)
SPANS = [(-70, -1), (-64, 63), (0, 0), (63, 64), (100, 400), (300, 310), (-500, 900)]


@pytest.fixture(scope="module")
def sets():
    """Days (numbers) per key: before and after 1970, at word ends, with gaps of several words, one day only."""
    rng = np.random.default_rng(3)
    return {1: sorted({-65, -64, -1, 0, 63, 64, 127, 128, 500}), 2: sorted(set(rng.integers(-300, 800, 400).tolist())), 3: [7]}


@pytest.fixture(scope="module")
def bits(spark, sets):
    rows = [(key, EPOCH + timedelta(days=d), d % 3 == 0) for key, days in sets.items() for d in days]
    rows += rows[:5]  # repeated days
    return day_bits(spark.createDataFrame(rows, "key INT, date DATE, third BOOLEAN"), "key", every=F.lit(True), third=F.col("third"))


@pytest.mark.parametrize("first, last", SPANS)
def test_ranges_equal_the_sets(spark, bits, sets, first, last):
    a, b = F.lit(first), F.lit(last)
    rows = bits.table.select(
        "key", bits.between("every", a, b).alias("days"), bits.between("third", a, b).alias("thirds"),
        bits.count("every", a, b).alias("n"), bits.count("third", a, b).alias("n_third"), bits.has("every", a).alias("has")).collect()
    assert len(rows) == len(sets)
    for r in rows:
        inside = [d for d in sets[r.key] if first <= d <= last]
        assert r.days == inside and r.n == len(inside)
        assert r.thirds == [d for d in inside if d % 3 == 0] and r.n_third == len(r.thirds)
        assert r.has is (first in sets[r.key])


def test_a_key_without_days_has_none(spark, bits):
    other = spark.createDataFrame([(9, 1)], "key INT, item INT")
    row = bits.beside(other, ["key", "item"], other, "left").select(
        bits.has("every", F.lit(7)).alias("has"), bits.count("every", F.lit(0), F.lit(99)).alias("n")).first()
    assert (row.has, row.n) == (False, 0)


def test_no_days_at_all(spark):
    empty = day_bits(spark.createDataFrame([], "key INT, date DATE"), "key", every=F.lit(True))
    assert empty.size == 0 and empty.table.isEmpty()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_sales_and_none_of_the_panel(tables, params, no_broadcast):
    """Above the broadcast threshold: the sales rows move once, by store-item, and nothing moves above the fill."""
    for made in (series.stockout_series(tables.sales, tables.store_day, params), series.trading_spine(tables.sales, tables.store_day, params)):
        text = plan(made)
        fill = text.index("Generate")
        assert "Exchange" not in text[:fill], text
        moved = re.findall(r"Exchange hashpartitioning\(store_nbr#\d+, item_nbr#\d+, \d+\)[^\n]*\n[^\n]*Project \[[^\]]*units", text)
        assert len(moved) <= 1, text
        assert "date#" not in " ".join(re.findall(r"Exchange hashpartitioning\(store_nbr#\d+, (date#\d+)", text))


def test_promotions_do_not_depend_on_broadcasting_the_bitmaps(spark, tables, params):
    def rows():
        fact = promo_baseline(tables.sales, tables.store_day, params)
        return [sorted(map(str, df.collect())) for df in (
            fact, promo_post_window(fact, tables.dim_date, tables.stg_store_day, params).drop("event_id"))]

    broadcast = rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SERIES = ("store_nbr INT, item_nbr INT, date DATE, units DOUBLE, no_sale_row BOOLEAN, full_day BOOLEAN, "
          "lambda_units DOUBLE, var_units DOUBLE, history_days BIGINT")


def test_runs_keep_their_full_days(spark):
    """Bit k is the k-th spine day of the run, closed days not counted; also for a run that opens the series."""
    def run_of(kinds, store):
        days = [date(2016, 2, 1) + timedelta(days=2 * i) for i in range(len(kinds))]
        return [(store, 1, d, 3.0 * (k == "s"), k != "s", k != "h", 2.0, 0.0, 28) for d, k in zip(days, kinds)]

    rows = zero_sale_runs(spark.createDataFrame(run_of("snhnsh", 1) + run_of("nhs", 2) + run_of("s" + "n" * 70, 3), SERIES)).collect()
    found = {(r.store_nbr, r.start_date): (r.full_days, r.run_days, r.spine_days) for r in rows}
    assert found[1, date(2016, 2, 3)] == (0b101, 2, 3)
    assert found[1, date(2016, 2, 11)] == (0, 0, 1)
    assert found[2, date(2016, 2, 1)] == (0b1, 1, 2)
    assert found[3, date(2016, 2, 3)] == (2**63 - 1, 70, 70)


def test_own_weeks_from_bitmaps_equal_the_lookup_in_the_series(tables, params):
    runs = stockout_runs(tables.stockout_series, params, keep_days=True)
    flagged, _ = flag_bh(runs, 0.9)  # nearly all runs, so that many weeks take part
    args = flagged, tables.stockout_series, tables.stg_store, params, "own"
    by_bits = weekly_stockout_rate(*args, calendar=series.trading_bits(tables.store_day, params))
    by_series = weekly_stockout_rate(*args)
    assert sorted(map(str, by_bits.collect())) == sorted(map(str, by_series.collect()))
    assert flagged.filter("is_flagged").count() > 0
    assert plan(by_bits).count("sale_date") <= plan(by_series).count("sale_date")


def test_a_bitmap_must_hold_the_longest_run(tables, params):
    from dataclasses import replace

    with pytest.raises(ValueError, match="max_run_days"):
        stockout_runs(tables.stockout_series, replace(params, max_run_days=64), keep_days=True)
