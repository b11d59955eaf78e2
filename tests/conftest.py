from __future__ import annotations

import os
import sys
from dataclasses import replace
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwatch import Params  # noqa: E402
from shelfwatch.plans.layers import Layers  # noqa: E402
from shelfwatch.sources.raw import RAW_SCHEMAS, read_raw  # noqa: E402
from tests.shop import write_shop  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params() -> Params:
    return replace(Params(), slice_start=date(2015, 1, 1), window_start=date(2016, 1, 1), window_end=date(2016, 3, 31))


@pytest.fixture(scope="session")
def shop(tmp_path_factory) -> str:
    """Folder with the five raw CSV files of the small shop."""
    return write_shop(tmp_path_factory.mktemp("shop"))


@pytest.fixture(scope="session")
def raw(spark, shop):
    return {name: read_raw(spark, f"{shop}/{name}.csv", name) for name in RAW_SCHEMAS}


@pytest.fixture(scope="session")
def tables(raw, params) -> Layers:
    return Layers(raw, params)
