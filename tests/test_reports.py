from datetime import date

import numpy as np
import pytest

from shelfwatch.operators import reports

NONE = None
# A four-family summary whose classes and order can be read off.
SUMMARY = [
    ("BEVERAGES", 900, 0.42, 0.38, 0.47, 800, -0.08, -0.10, -0.06, 800, 0.12, 0.09, 0.15),
    ("DAIRY", 400, 0.18, 0.12, 0.24, 350, -0.03, -0.05, -0.01, 350, 0.02, -0.01, 0.05),
    ("PRODUCE", 300, 0.05, 0.01, 0.09, 20, NONE, NONE, NONE, 20, NONE, NONE, NONE),
    ("BREAD", 200, 0.30, 0.25, 0.35, 150, -0.40, -0.45, -0.35, 150, -0.10, -0.15, -0.05),
]
SUMMARY_SCHEMA = ("family STRING, n_events BIGINT, uplift_median DOUBLE, uplift_lo DOUBLE, uplift_hi DOUBLE, "
                  "n_dip_events BIGINT, dip_median DOUBLE, dip_lo DOUBLE, dip_hi DOUBLE, "
                  "n_net_events BIGINT, net_median DOUBLE, net_lo DOUBLE, net_hi DOUBLE")
# Store-weeks with yearly rates of 10%, 2% and 1%.
WEEKLY = [(1, "Quito", date(2016, 8, 15), 10, 1000, 0.01), (1, "Quito", date(2016, 8, 22), 30, 1000, 0.03),
          (2, "Cuenca", date(2016, 8, 15), 2, 100, 0.02), (2, "Cuenca", date(2016, 8, 22), 0, 100, 0.0),
          (3, None, date(2016, 8, 22), 5, 50, 0.1)]


@pytest.fixture(scope="module")
def summary(spark):
    return spark.createDataFrame(SUMMARY, SUMMARY_SCHEMA)


@pytest.fixture(scope="module")
def weekly(spark):
    return spark.createDataFrame(
        WEEKLY, "store_key INT, city STRING, week_start DATE, flagged_days BIGINT, item_days BIGINT, rate DOUBLE")


def test_uplift_ranking(summary):
    rows = reports.uplift_ranking(summary).collect()
    assert [r.family for r in rows] == ["BEVERAGES", "BREAD", "DAIRY", "PRODUCE"]
    assert [r.error_up_pct for r in rows] == [5.0, 5.0, 6.0, 4.0]
    assert [r.error_down_pct for r in rows] == [4.0, 5.0, 6.0, 4.0]
    assert [r.family for r in rows if r.is_top] == ["BEVERAGES"] and rows[0].uplift_pct == 42.0


def test_one_family_is_top_among_equals(spark, summary):
    twin = spark.createDataFrame([("AAA", *SUMMARY[0][1:])], SUMMARY_SCHEMA)
    assert [r.family for r in reports.uplift_ranking(summary.unionAll(twin)).collect() if r.is_top] == ["BEVERAGES"]


def test_payback(summary):
    rows = reports.payback_class(summary).collect()
    assert [(r.family, r.payback) for r in rows] == [("BREAD", "loses"), ("DAIRY", "unclear"), ("BEVERAGES", "pays")]
    assert (rows[2].uplift_pct, rows[2].dip_pct) == (42.0, -8.0)
    assert tuple(reports.payback_count(summary).first()) == (1, 3)


def test_payday_gap_needs_both_sides(spark):
    rows = [("DAIRY", v, t) for t, values in ((False, (0.1, 0.1, 0.2, 0.2)), (True, (0.5, 0.5, 0.7, 0.7))) for v in values]
    rows += [("BREAD", 0.4, False)] * 9 + [("BREAD", 0.1, True)] * 3
    events = spark.createDataFrame(rows, "family STRING, uplift DOUBLE, touches_payday_or_holiday BOOLEAN")
    gaps = reports.payday_gap(events, 4)
    (row,) = gaps.collect()
    assert (row.family, row.other_pct, row.touching_pct, row.gap) == ("DAIRY", 15.0, 60.0, pytest.approx(0.45))
    assert tuple(reports.payday_headline(gaps).first()) == (1, 1)


def test_store_ranking_and_grid(weekly):
    rows = reports.store_stockout_rank(weekly).collect()
    assert [(r.store_key, r.city, round(r.rate, 6)) for r in rows] == [(3, None, 0.1), (1, "Quito", 0.02), (2, "Cuenca", 0.01)]
    assert reports.worst_store(weekly).first().store_key == 3
    grid = {(r.store_key, r.city, r.week_start): r.rate_pct for r in reports.stockout_grid(weekly).collect()}
    assert len(grid) == 6
    assert grid[(3, None, date(2016, 8, 15))] is None
    assert grid[(1, "Quito", date(2016, 8, 22))] == 3.0 and grid[(2, "Cuenca", date(2016, 8, 22))] == 0.0
    cap = reports.stockout_grid_cap(weekly).first().cap_pct
    assert cap == pytest.approx(np.percentile([1.0, 3.0, 2.0, 0.0, 10.0], 95))


def test_weeks_nobody_was_tested_in_are_not_in_the_grid(spark, weekly):
    later = spark.createDataFrame([(1, "Quito", date(2016, 9, 19), 1, 10, 0.1)], weekly.schema)
    assert reports.stockout_grid(weekly.unionAll(later)).select("week_start").distinct().count() == 3


def test_dispersion_reports(spark):
    values = [0.5, 2.0, 4.0, 8.0, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "dispersion DOUBLE")
    assert reports.overdispersed_share(df).first().share_over_1 == 0.75
    head = reports.dispersion_headline(df).first()
    assert (head.median_dispersion, head.share_over_1) == (2.0, 0.6)
    rows = reports.dispersion_histogram(df).collect()
    counts, edges = np.histogram(np.log10([0.5, 2.0, 4.0, 8.0]), bins=60)
    assert {r.bin: r.store_items for r in rows} == {i: n for i, n in enumerate(counts) if n}
    assert [r.from_log10 for r in rows] == pytest.approx([edges[r.bin] for r in rows])
    same = spark.createDataFrame([(3.0,)] * 5, "dispersion DOUBLE")
    assert [(r.bin, r.store_items) for r in reports.dispersion_histogram(same).collect()] == [(0, 5)]


def test_monthly_and_profile(tables):
    months = [(r.year, r.month_num, r.flagged_days, r.est_lost_units)
              for r in reports.stockout_month(tables.fact_stockout_risk, tables.dim_date).collect()]
    assert months == [(2016, 1, 1, 5.0), (2016, 2, 1, 5.0)]
    profile = {r.table_name: r for r in reports.layer_profile(tables.tables(["sales", "store_day"])).collect()}
    assert (profile["sales"].first_day, profile["sales"].last_day) == (date(2015, 1, 1), date(2016, 3, 31))
    assert profile["store_day"].rows == tables.store_day.count()
