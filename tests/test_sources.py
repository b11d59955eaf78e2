import gzip
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions.intervals import points_in_intervals
from shelfwatch.params import Params
from shelfwatch.plans.files import catalog_tables
from shelfwatch.operators.runs import stockout_runs
from shelfwatch.sources import splits
from shelfwatch.sources.star_schema import COLUMNS, StarSchemaTables
from shelfwatch.sources.statistics import _bounds, column_ends, profile_files

SMALL = "/root/testdata/sf0.001"


# footers

def test_ends_of_a_column_come_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).repartition(3).selectExpr(
        "id", "date_add(DATE '2019-12-30', cast(id as int)) AS date", "cast(null as int) AS none",
        "cast(timestampadd(MINUTE, id, TIMESTAMP_NTZ '1969-12-31 23:00:00') as timestamp_ntz) AS at")
    rows.write.parquet(path)
    for column in ("id", "date", "at"):
        df, _ = _bounds(spark, path, column)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert f"PushedAggregation: [COUNT(*), MIN({column}), MAX({column})]" in text, text
        exact = rows.agg(F.count("*"), F.min(column), F.max(column)).first()
        ends = column_ends(spark, path, column)
        assert (ends.rows, ends.first, ends.last) == tuple(exact)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


def test_profile_of_files_and_of_an_empty_table(spark, tmp_path):
    days = spark.range(10).selectExpr("date_add(DATE '2020-01-01', cast(id as int)) AS date")
    days.write.parquet(str(tmp_path / "days"))
    days.limit(0).write.parquet(str(tmp_path / "nothing"))
    rows = {r.table_name: tuple(r)[1:] for r in profile_files(
        spark, {n: str(tmp_path / n) for n in ("days", "nothing")}).collect()}
    assert rows == {"days": (10, date(2020, 1, 1), date(2020, 1, 10)), "nothing": (0, None, None)}


def test_holidays_span_the_years_of_the_data(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    first, last = lines.agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    years = StarSchemaTables(spark, SMALL)["holidays_events"].select(F.year("date").alias("y")).distinct().collect()
    assert sorted(r.y for r in years) == list(range(first, last + 1))


# splits

def write_gzip(folder, files, lines):
    folder.mkdir()
    for i in range(files):
        with gzip.open(folder / f"part-{i}.csv.gz", "wt") as f:
            f.write("id\n" + "".join(f"{j:012d}\n" for j in range(lines)))
    return str(folder)


def test_partitions_follow_the_unpacked_bytes(spark, tmp_path):
    path = write_gzip(tmp_path / "two", 2, 50_000)  # 650 kB each
    assert splits.partitions_of(spark, path, partition_bytes=100_000) in range(12, 15)
    assert splits.partitions_of(spark, path, partition_bytes=650_000 * 2) is None  # two files are enough
    assert splits.partitions_of(spark, write_gzip(tmp_path / "tiny", 1, 1)) is None


def test_files_that_can_be_split_are_left_alone(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("id\n1\n")
    assert splits.partitions_of(spark, str(tmp_path)) is None


def test_expansion_of_the_first_stretch():
    noise = random.Random(1).randbytes(300_000)
    whole = gzip.compress(noise + bytes(3_000_000))
    assert splits.expansion(whole) == pytest.approx(3_300_000 / len(whole), rel=0.01)
    assert splits.expansion(gzip.compress(noise)[:100_000]) == pytest.approx(1, rel=0.05)
    assert splits.expansion(b"") == 0


# catalog

def test_catalog_tables_of_a_run_need_no_exchange_by_store_item(spark):
    p = Params(slice_start=date(1995, 1, 2), window_start=date(1996, 9, 1), window_end=date(2000, 12, 31))
    made = catalog_tables(spark, StarSchemaTables(spark, SMALL), p)
    other = catalog_tables(spark, StarSchemaTables(spark, SMALL), p)  # its schemas do not clash
    for tables in (made, other):
        text = stockout_runs(tables.stockout_series, p)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and "Exchange" not in text, text


# intervals

def brute(points, intervals):
    return sorted((k, x, i) for k, x in points for j, a, b, i in intervals if k == j and a is not None and b is not None and a <= x <= b)


@pytest.mark.parametrize("seed, longest", [(0, 1), (1, 9), (2, 200), (3, 5000)])
def test_points_in_intervals_equal_the_range_join(spark, seed, longest):
    """Half of everything has one key; lengths from one day to ``longest``; ends that meet, repeated rows, nulls."""
    rng = random.Random(seed)
    key = lambda: rng.choice([1, 1, 1, 2, 3])
    points = [(key(), rng.randint(-300, 300)) for _ in range(300)] + [(1, 0), (1, 0)]
    intervals = []
    for i in range(80):
        a = rng.randint(-350, 300)
        intervals.append((key(), a, a + rng.randint(0, longest) - (3 if i % 9 == 0 else 0), i))
    intervals += [(1, 0, 0, 900), (1, None, 5, 901), (None, 0, 5, 902)]
    left = spark.createDataFrame(points, "k INT, x INT")
    right = spark.createDataFrame(intervals, "k INT, a INT, b INT, i INT")
    joined = points_in_intervals(left, right, ["k"], "x", "a", "b")
    assert joined.columns == ["k", "x", "a", "b", "i"]
    assert sorted((r.k, r.x, r.i) for r in joined.collect()) == brute(points, intervals)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_intervals(spark):
    points = spark.createDataFrame([(1, 1)], "k INT, x INT")
    assert points_in_intervals(points, spark.createDataFrame([], "k INT, a INT, b INT"), ["k"], "x", "a", "b").isEmpty()


def test_lines_find_their_store_without_a_shuffle(spark, tmp_path):
    """While suppliers fit a broadcast, line items stay where they lie."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    write("region", [(0, "r")], COLUMNS["region"])
    write("nation", [(k, f"n{k}", 0) for k in range(25)], COLUMNS["nation"])
    write("supplier", [(k, k % 26) for k in range(3000)] + [(7, 3), (None, 1)], COLUMNS["supplier"])
    day = datetime(1998, 2, 3)
    write("lineitem", [(i, 1, k, 2.0, 0.0, "N", "O", day) for i, k in enumerate([7, 25, 8, 9999, None, 8])], COLUMNS["lineitem"])
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, str(100_000))
    try:
        lines = StarSchemaTables(spark, str(tmp_path))._lines()
        assert "Exchange hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.l_orderkey, r.store_nbr, r.date) for r in lines.collect()) == [
            (i, 0, day.date()) for i in (0, 0, 2, 5)]  # 25 is of no nation, 7 is listed twice
    finally:
        spark.conf.set(threshold, before)
