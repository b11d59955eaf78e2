import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions.stored import recover_folder, replace_folder
from shelfwatch.plans.pipeline import FolderStore
from shelfwatch.plans.publish import IncompleteRelease, NotPublished, Shelf, run_stamp


@pytest.fixture
def shelf(spark, tmp_path):
    return Shelf(spark, str(tmp_path / "shelf"))


def tables(spark, start, names=("a", "b", "c"), rows=20):
    return {name: spark.range(start, start + rows).withColumn("of", F.lit(name)) for name in names}


def ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_see_the_last_release(spark, shelf):
    with pytest.raises(NotPublished):
        shelf.current()
    first = shelf.publish(tables(spark, 0))
    held = shelf.table("b")  # resolved before the next release
    second = shelf.publish(tables(spark, 100))
    assert shelf.current() == second != first and shelf.releases() == [first, second]
    assert ids(shelf.table("b")) == list(range(100, 120)) and ids(held) == list(range(20))
    assert ids(shelf.table("b", first)) == list(range(20))


def test_a_job_that_dies_between_tables_leaves_the_old_set(spark, shelf):
    first = shelf.publish(tables(spark, 0))
    broken = tables(spark, 100)
    broken["b"] = broken["b"].withColumn("of", F.when(F.col("id") < 110, F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        shelf.publish(broken)
    assert len(shelf.releases()) == 2  # the unfinished one holds table a
    assert shelf.current() == first and all(ids(shelf.table(n)) == list(range(20)) for n in "abc")
    third = shelf.publish(tables(spark, 200))
    assert shelf.prune(keep=1) and shelf.releases() == [third]
    assert ids(shelf.table("c")) == list(range(200, 220))


def test_a_release_that_lost_rows_is_not_pointed_to(spark, shelf, monkeypatch):
    first = shelf.publish(tables(spark, 0))
    honest = Shelf.table
    monkeypatch.setattr(Shelf, "table", lambda self, name, release=None: honest(self, name, release).filter("id % 2 = 0"))
    with pytest.raises(IncompleteRelease, match="20 rows written, 10 found"):
        shelf.publish(tables(spark, 100))
    monkeypatch.undo()
    assert shelf.current() == first


def test_prune_keeps_the_current_release_and_those_before_it(spark, shelf):
    made = [shelf.publish(tables(spark, i, names=("a",), rows=1)) for i in range(4)]
    assert shelf.prune(keep=2) == made[:2] and shelf.releases() == made[2:]
    assert shelf.prune(keep=2) == []


def test_a_saved_table_may_be_made_from_itself(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path))
    once = store.save("silver", "days", spark.range(5))
    twice = store.save("silver", "days", once.union(once))
    assert ids(twice) == sorted(2 * list(range(5)))
    assert os.listdir(tmp_path / "silver") == ["days"]


def test_a_save_that_dies_leaves_the_old_table(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path))
    store.save("silver", "days", spark.range(5))
    with pytest.raises(Exception, match="lost"):
        store.save("silver", "days", spark.range(9).select(F.when(F.col("id") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")))
    assert ids(store.table("silver", "days")) == list(range(5))


def test_a_swap_that_stops_half_way_is_undone(spark, tmp_path):
    path, staged = str(tmp_path / "t"), str(tmp_path / "staged")
    spark.range(3).write.parquet(path)
    os.rename(path, path + ".before")  # stopped between the two renames
    recover_folder(spark, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]
    spark.range(7).write.parquet(staged)
    os.mkdir(path + ".before")  # stopped before the last step
    replace_folder(spark, staged, path)
    assert ids(spark.read.parquet(path)) == list(range(7)) and sorted(os.listdir(tmp_path)) == ["t"]


def test_an_audit_tells_the_run_and_the_rows_of_every_table(spark, shelf):
    stamp = run_stamp() - timedelta(hours=1)
    first = shelf.publish({**tables(spark, 0), "none": spark.range(0)}, stamp)
    rows = shelf.audit().collect()
    assert {r.table_name: r.rows for r in rows} == {"a": 20, "b": 20, "c": 20, "none": 0}
    assert {(r.release, r.started_at.timestamp()) for r in rows} == {(first, stamp.timestamp())}
    written = [r.written_at for r in sorted(rows, key=lambda r: ["a", "b", "c", "none"].index(r.table_name))]
    assert written == sorted(written) and min(written) > rows[0].started_at


def test_audits_outlive_releases_and_lost_jobs_leave_none(spark, shelf):
    made = [shelf.publish(tables(spark, i, names=("a",), rows=i)) for i in (1, 2)]
    with pytest.raises(Exception, match="lost"):
        shelf.publish({"a": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))})
    shelf.prune(keep=1)
    assert [(r.release, r.rows) for r in shelf.history().orderBy("release").collect()] == list(zip(made, (1, 2)))
    assert [r.rows for r in shelf.audit(made[0]).collect()] == [1]
