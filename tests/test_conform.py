from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.conform import dim_date
from shelfwatch.sources.raw import read_raw
from shelfwatch.sources.star_schema import Grain, StarSchemaTables


def test_raw_types_and_unknown_flags(raw):
    assert dict(raw["train"].dtypes) == {"id": "bigint", "date": "date", "store_nbr": "int", "item_nbr": "int",
                                         "unit_sales": "double", "onpromotion": "boolean"}
    assert raw["train"].filter("store_nbr = 2 AND onpromotion IS NULL").count() == 91


def test_malformed_row_fails_the_read(spark, tmp_path):
    (tmp_path / "stores.csv").write_text("store_nbr,city,state,type,cluster\n1,Quito,Pichincha,A,one\n")
    with pytest.raises(Exception):
        read_raw(spark, str(tmp_path / "stores.csv"), "stores").collect()


def test_spread_keeps_all_rows(spark, shop, raw):
    spread = read_raw(spark, f"{shop}/train.csv", "train", spread=7)
    assert spread.rdd.getNumPartitions() == 7
    assert spread.count() == raw["train"].count()


def test_returns_are_split_from_units(tables):
    row = tables.sales.filter("store_nbr = 2 AND item_nbr = 101 AND date = '2016-01-05'").first()
    assert (row.units, row.return_units) == (0.0, 1.0)


def test_flag_is_unknown_only_when_every_row_is(spark, params):
    from shelfwatch.operators.conform import sales_daily

    train = spark.createDataFrame(
        [(1, date(2016, 1, 1), 1, 1, 2.0, None), (2, date(2016, 1, 1), 1, 1, -1.0, True),
         (3, date(2016, 1, 1), 1, 2, None, None), (4, date(2014, 1, 1), 1, 1, 9.0, True)],
        "id BIGINT, date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion BOOLEAN")
    rows = {r.item_nbr: r for r in sales_daily(train, params).collect()}
    assert (rows[1].units, rows[1].return_units, rows[1].on_promo) == (2.0, 1.0, True)
    assert (rows[2].units, rows[2].return_units, rows[2].on_promo) == (0.0, 0.0, None)


def test_receipts_start_with_the_slice(tables, params):
    assert tables.store_day.agg(F.min("date")).first()[0] == params.slice_start
    assert tables.store_day.filter("store_nbr = 1 AND date = '2016-02-10'").first().receipts == 100


def test_transferred_and_local_holidays_do_not_count(tables):
    assert {r.date for r in tables.national_holidays.collect()} == {date(2016, 1, 1), date(2016, 2, 9)}


def test_dim_date_has_every_day_once(tables):
    days = sorted(r.date for r in tables.dim_date.collect())
    assert days == [date(2015, 1, 1) + timedelta(days=i) for i in range(len(days))] and days[-1] == date(2016, 3, 31)


def test_dim_date_attributes(tables):
    rows = {r.date: r for r in tables.dim_date.collect()}
    saturday = rows[date(2016, 1, 2)]
    assert (saturday.date_key, saturday.month_key, saturday.weekday_num, saturday.weekday_name, saturday.month_name,
            saturday.quarter, saturday.is_weekend, saturday.is_national_holiday) == (
        20160102, 201601, 6, "Sat", "Jan", 1, True, False)
    assert (rows[date(2016, 1, 1)].iso_year, rows[date(2016, 1, 1)].iso_week) == (2015, 53)
    for day, row in rows.items():
        assert (row.iso_year, row.iso_week, row.weekday_num) == tuple(day.isocalendar())


def test_a_date_far_off_is_an_error(spark, tables):
    far = spark.createDataFrame([(date(2216, 1, 1),)], "date DATE")
    with pytest.raises(Exception, match="span more than"):
        dim_date(tables.sales.select("date").union(far), tables.store_day, tables.national_holidays).collect()


def test_opening_date_is_unknown_for_stores_open_at_the_start(tables):
    opened = {r.store_key: r.opening_date for r in tables.stg_store.collect()}
    assert opened == {1: None, 2: date(2015, 6, 1), 3: date(2016, 1, 1), 4: date(2016, 1, 1), 5: date(2016, 1, 1)}


def test_item_and_store_day_contract(tables):
    produce = tables.stg_item.filter("item_key = 102").first()
    assert (produce.family, produce.is_perishable) == ("PRODUCE", True)
    assert tables.stg_store_day.filter("store_key = 3 AND date_key = 20160115").first().receipts == 90


@pytest.mark.parametrize("grain", ["region", "nation", "supplier"])
def test_the_star_schema_keeps_every_row(spark, grain):
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    raw = StarSchemaTables(spark, folder, Grain(grain))
    assert raw["train"].count() == lines.count()
    assert raw["train"].agg(F.sum(F.abs("unit_sales"))).first()[0] == lines.agg(F.sum("l_quantity")).first()[0]
    assert raw["train"].select("store_nbr").distinct().join(raw["stores"], "store_nbr", "left_anti").isEmpty()
    assert raw["train"].select("item_nbr").distinct().join(raw["items"], "item_nbr", "left_anti").isEmpty()
    orders = raw["transactions"].join(raw["train"].groupBy("date", "store_nbr").agg(F.countDistinct("id").alias("n")), ["date", "store_nbr"])
    assert orders.filter("n <> transactions").isEmpty()


def test_some_suppliers_open_late(spark):
    stores = dim_store(StarSchemaTables(spark, "/root/testdata/sf0.01", Grain("supplier")))
    opened = stores.filter("opening_date IS NOT NULL").count()
    assert 0 < opened < stores.count()


def dim_store(raw):
    from shelfwatch.operators import conform

    return conform.dim_store(raw["stores"], raw["transactions"])
