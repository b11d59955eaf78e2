import os
import re

import pytest

from shelfwatch.functions.stored import store
from shelfwatch.operators.promo import promo_baseline, promo_events_raw
from shelfwatch.operators.quality import ChecksFailed
from shelfwatch.operators.runs import stockout_runs
from shelfwatch.operators.series import stockout_series
from shelfwatch.plans.layers import EXPORTED, GOLD, SILVER, Layers
from shelfwatch.plans.pipeline import CatalogStore, FolderStore, ViewStore, build, counts_table, export, load_raw, run
from shelfwatch.plans.publish import Shelf


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))", plan(df))


@pytest.fixture(scope="module")
def written(spark, shop, params, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    store = FolderStore(spark, str(root / "tables"))
    return root, run(spark, store, shop, str(root / "export"), params, extension=".csv")


def test_full_run_writes_every_table(spark, written, tables):
    root, made = written
    for layer, names in (("silver", SILVER), ("gold", GOLD)):
        for name in names:
            stored = spark.read.parquet(f"{root}/tables/{layer}/{name}")
            expected = getattr(tables, name)
            assert stored.columns == expected.columns
            assert sorted(map(str, stored.collect())) == sorted(map(str, expected.collect())), name
    shelf = Shelf(spark, str(root / "export"))
    assert sorted(os.listdir(root / "export" / "releases" / shelf.current())) == sorted(EXPORTED)
    assert shelf.table("fact_stockout_run").count() == made.fact_stockout_run.count()


def test_load_counts_rows(spark, shop, tmp_path, raw):
    counts = load_raw(spark, FolderStore(spark, str(tmp_path)), shop, ".csv", spread=3)
    assert counts == {name: df.count() for name, df in raw.items()}


def test_views_answer_parameterised_sql(spark, shop, params, raw):
    store = ViewStore(spark)
    counts = load_raw(spark, store, shop, ".csv")
    build(store, params)
    row = spark.sql(
        """SELECT count(*) AS days, min(date) AS first_day, min(units_before) AS least
           FROM (SELECT date, sum(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY unix_date(date)
                        RANGE BETWEEN :lookback_days PRECEDING AND 1 PRECEDING) AS units_before
                 FROM silver__sales) WHERE date >= :stockout_from""", args=params.sql_args()).first()
    assert row.first_day == params.window_start and row.days > 0 and row.least is not None
    months = spark.sql("SELECT d.month_num, count(*) AS n FROM gold__fact_stockout_risk JOIN gold__dim_date d "
                       "USING (date_key) GROUP BY 1 ORDER BY 1").collect()
    assert [tuple(r) for r in months] == [(1, 1), (2, 1)]
    assert counts == {name: df.count() for name, df in raw.items()}
    assert dict(map(tuple, counts_table(spark, counts).collect())) == counts


def test_failed_checks_publish_nothing(spark, shop, params, tmp_path):
    store = FolderStore(spark, str(tmp_path / "tables"))
    load_raw(spark, store, shop, ".csv")
    store.save("bronze", "items", spark.createDataFrame(
        [(101, "GROCERY I", 1, 0)], "item_nbr INT, family STRING, class INT, perishable INT"))
    with pytest.raises(ChecksFailed, match="fact_sales_orphan_item"):
        export(build(store, params), str(tmp_path / "export"))
    assert not (tmp_path / "export").exists()


def test_catalog_tables_need_no_exchange_by_store_item(spark, shop, params, tables):
    store = CatalogStore(spark, buckets=4)
    load_raw(spark, store, shop, ".csv")
    made = build(store, params)
    assert sorted(map(str, made.fact_stockout_run.collect())) == sorted(map(str, tables.fact_stockout_run.collect()))
    for layer, name in (("silver", "sales"), ("silver", "stockout_series"), ("gold", "fact_sales")):
        assert len(store.table(layer, name).inputFiles()) <= 4  # one file per bucket
    sales, store_day = store.table("silver", "sales"), store.table("silver", "store_day")
    for df in (
        stockout_series(sales, store_day, params),
        stockout_runs(store.table("silver", "stockout_series"), params),
        promo_baseline(sales, store_day, params),
        promo_events_raw(store.table("gold", "fact_sales"), store.table("gold", "dim_date"), params),
    ):
        assert not [e for e in exchanges(df) if "item" in e], plan(df)


def test_one_exchange_by_store_item_from_plain_tables(spark, written, params):
    _, made = written
    runs = stockout_runs(stockout_series(made.sales, made.store_day, params), params)
    assert len([e for e in exchanges(runs) if "item_nbr" in e]) == 1, plan(runs)
    events = promo_events_raw(promo_baseline(made.sales, made.store_day, params), made.dim_date, params)
    assert len([e for e in exchanges(events) if "item" in e]) == 1, plan(events)


def test_no_step_gathers_rows_in_one_task(spark, written, params):
    """Only one-row aggregates may use a single partition: never a window, a sort or a join side."""
    _, made = written
    for name in ("fact_stockout_run", "stockout_store_week", "fact_promo_event", "fact_sales", "stockout_series"):
        text = plan(getattr(made, name))
        for match in re.finditer(r"^(.*)Exchange SinglePartition", text, re.M):
            above = text[:match.start()].rstrip().splitlines()[-1]
            assert "HashAggregate" in above, text


def test_results_do_not_depend_on_broadcasting(spark, tables, params):
    """Without any broadcast of the calendar the joins fall back to exchanges; the rows stay the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = Layers(tables.raw, params)
        for name in ("stockout_series", "fact_sales", "fact_promo_event", "fact_stockout_run", "stockout_store_week"):
            assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(tables, name).collect()))
        assert "SortMergeJoin" in plan(again.stockout_series)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_date_bound_reaches_the_scan(spark, written, params):
    _, made = written
    text = plan(stockout_series(made.sales, made.store_day, params))
    assert "GreaterThanOrEqual(date," in text
    assert "on_promo" not in re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)


def test_stored_tables_are_pruned_and_filtered(spark):
    kept = store(spark.range(1000).selectExpr("id", "id * 2 AS twice", "CAST(id AS STRING) AS name"), "plan")
    text = plan(kept.filter("twice > 10").select("id"))
    assert "GreaterThan(twice,10)" in text and "ReadSchema: struct<id:bigint,twice:bigint>" in text
    assert kept.count() == 1000
