import gzip
from datetime import date
from glob import glob

import pytest

from shelfwatch.operators import quality, reconcile
from shelfwatch.plans.pipeline import CHECKED
from shelfwatch.sources.raw import RAW_SCHEMAS, read_raw, slice_counts, slice_raw

START, END = date(2016, 5, 1), date(2016, 5, 31)
FACT_SCHEMA = "date_key INT, store_key INT, item_key INT, units DOUBLE, baseline_units DOUBLE"
RISK_SCHEMA = "date_key INT, store_key INT, item_key INT, expected_units DOUBLE"
# an earlier producer: every day of May and one day before it, two stores; item 12 has no baseline
FACTS = [(20160500 + d, s, item, float(d), None if item == 12 else 1.5 * d) for d in range(1, 32) for s in (1, 2) for item in (11, 12)]
BEFORE = [(20160430, 1, 11, 77.0, 7.7)]
FLAGS = [(20160500 + d, s, 11, 3.0 + d) for d in range(1, 32) for s in range(1, 11)]


def test_shop_passes_all_checks(tables):
    checks = quality.dq_checks(tables.tables(CHECKED))
    assert checks.count() == 8
    assert quality.failing(checks).isEmpty()
    quality.require_clean(checks)


@pytest.mark.parametrize("table, change, expected", [
    ("fact_sales", lambda df: df.unionAll(df.limit(3)), {"fact_sales_duplicate_keys": 3, "rows_silver_vs_gold": 3, "units_silver_vs_gold": 1}),
    ("fact_sales", lambda df: df.withColumn("units", df.units + 0.000001), {"units_silver_vs_gold": 1}),
    ("stg_item", lambda df: df.filter("item_key <> 102"), {"fact_sales_orphan_item": "item_key = 102"}),
    ("stg_store", lambda df: df.filter("store_key > 4"), {"fact_sales_orphan_store": "store_key <= 4"}),
    ("dim_date", lambda df: df.filter("date_key <> 20160210"),
     {"fact_sales_orphan_date": "date_key = 20160210", "fact_stockout_risk_orphan_date": 1}),
    ("fact_stockout_risk", lambda df: df.unionAll(df), {"fact_stockout_risk_duplicate_keys": 2}),
])
def test_each_check_finds_its_fault(tables, table, change, expected):
    good = tables.tables(CHECKED)
    found = {r.check: r.violations for r in quality.failing(quality.dq_checks({**good, table: change(good[table])})).collect()}
    assert found == {k: good["fact_sales"].filter(v).count() if isinstance(v, str) else v for k, v in expected.items()}


def test_missing_key_parts_and_empty_facts(tables):
    good = tables.tables(CHECKED)
    keyless = good["fact_sales"].limit(2).selectExpr("date_key", "CAST(NULL AS INT) AS store_key", "item_key", "units")
    row = quality.fact_measures(keyless, {"store_key": good["stg_store"]}, "units").first()
    assert (row.rows, row.duplicates, row.orphans_store_key) == (2, 2, 2)
    row = quality.fact_measures(keyless.limit(0), {"store_key": good["stg_store"]}).first()
    assert (row.rows, row.duplicates, row.orphans_store_key, row.units) == (0, 0, 0, None)


def test_failing_checks_raise(tables):
    good = tables.tables(CHECKED)
    with pytest.raises(quality.ChecksFailed, match="fact_sales_orphan_store"):
        quality.require_clean(quality.dq_checks({**good, "stg_store": good["stg_store"].filter("store_key > 1")}))


def test_each_input_is_read_once(spark, tables, tmp_path):
    stored = {}
    for name, df in tables.tables(CHECKED).items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    text = quality.dq_checks(stored)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == len(CHECKED) + 1  # the dates serve both facts


@pytest.fixture
def compare(spark):
    """Checks that fail, by name, for changed rows of the new producer."""
    def run(facts=FACTS, flags=FLAGS, threshold=3.0):
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        report = reconcile.reconcile(frame(facts, FACT_SCHEMA), frame(flags, RISK_SCHEMA),
                                     frame(FACTS + BEFORE, FACT_SCHEMA), frame(FLAGS, RISK_SCHEMA), START, END, threshold).collect()
        assert len(report) == 8
        return {r.check: r.measured for r in report if not r.passed}
    return run


def without(rows, n):
    return rows[n:]


def test_same_producers_agree(compare):
    assert compare() == {}
    assert compare(FACTS + [(20160601, 1, 11, 5.0, 5.0)]) == {}  # outside the window


@pytest.mark.parametrize("change, failing", [
    (lambda d, s, i, u, b: (d, s, i, u, b + 0.02 if b else b), {"baselines_drifted": 62}),
    (lambda d, s, i, u, b: (d, s, i, u, b + 0.005 if b else b), {}),
    (lambda d, s, i, u, b: (d, s, i, u, 1.0 if i == 12 and d == 20160510 else b), {"baselines_added": 2}),
    (lambda d, s, i, u, b: (d, s, i, u, None if d == 20160510 else b), {"baselines_lost_share": pytest.approx(2 / 62)}),
    (lambda d, s, i, u, b: (d, s, i, u * (1 + 2e-6), b), {"sales_unit_gap": pytest.approx(2e-6)}),
])
def test_changed_facts(compare, change, failing):
    assert compare([change(*row) for row in FACTS]) == failing


def test_missing_rows(compare):
    assert set(compare(without(FACTS, 4))) == {"sales_row_gap", "sales_unit_gap"}
    assert set(compare([], [])) >= {"sales_rows", "sales_row_gap", "flags_jaccard"}


@pytest.mark.parametrize("added, threshold, failing", [
    ([(20160512, 77, 11, 8.0)], 3.0, {"flags_added": 1}),
    ([(20160512, 77, 11, 3.0)], 3.0, {}),
    ([(20160512, 77, 11, 3.0)], 2.0, {"flags_added": 1}),
    ([(20160512, 77, 11, 2.0)], 2.0, {}),
])
def test_added_flags_pass_only_at_the_threshold(compare, added, threshold, failing):
    assert compare(flags=FLAGS + added, threshold=threshold) == failing


def test_lost_flags_must_stay_rare(compare):
    assert compare(flags=without(FLAGS, 1)) == {}
    assert compare(flags=without(FLAGS, 10)) == {"flags_jaccard": pytest.approx(300 / 310)}


def test_a_side_may_be_a_folder_or_one_file(spark, tmp_path):
    df = spark.createDataFrame(FLAGS[:5], RISK_SCHEMA)
    df.write.parquet(str(tmp_path / "a" / "fact_stockout_risk"))
    (tmp_path / "b").mkdir()
    df.toPandas().to_parquet(tmp_path / "b" / "fact_stockout_risk.parquet")
    for side in "ab":
        rows = reconcile.read_contract(spark, str(tmp_path / side), "fact_stockout_risk").collect()
        assert sorted(map(tuple, rows)) == sorted(FLAGS[:5])


def lines(pattern):
    found = []
    for path in sorted(glob(pattern)):
        with gzip.open(path, "rt", encoding="utf-8") as f:
            found.append(f.read().splitlines())
    return found


def test_slice_keeps_text_and_filters_sales_only(spark, shop, tmp_path):
    counts = slice_raw(spark, shop, str(tmp_path), date(2016, 1, 1), date(2016, 1, 31))
    for name in RAW_SCHEMAS:
        with open(f"{shop}/{name}.csv", encoding="utf-8") as f:
            header, *rows = f.read().splitlines()
        if name == "train":
            rows = [r for r in rows if "2016-01-01" <= r.split(",")[1] <= "2016-01-31"]
        written = lines(f"{tmp_path}/{name}.csv.gz/*.gz")
        assert all(part[0] == header for part in written)
        assert [r for part in written for r in part[1:]] == rows
        assert counts[name] == len(rows)
        assert read_raw(spark, f"{tmp_path}/{name}.csv.gz", name).count() == len(rows)


def test_slice_counts_table(raw, spark, shop):
    rows = {r.name: r.rows for r in slice_counts(raw, date(2016, 1, 1), date(2016, 1, 31)).collect()}
    assert rows["items"] == 2 and rows["train"] == raw["train"].filter(
        "date BETWEEN DATE '2016-01-01' AND DATE '2016-01-31'").count()
