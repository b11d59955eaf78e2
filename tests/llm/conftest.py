from __future__ import annotations

import pytest

from shelfwatch.functions.workers import importable

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# columns named like results and intermediates
CLASHING = ["size", "shard", "slot", "score", "key", "n", "spans", "words", "row", "before", "total", "part", "taken", "target",
            "hash", "licenses", "contamination", "pii", "label", "class_id", "kept", "n_links", "copies", "run", "path", "host"]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def small(spark):
    """Reads a table of the smallest data set."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
ODD = [
    (1, None, "en", "a", 0),
    (None, "some text without an id at all here", "en", None, 3),
    (None, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "de", "a", 3),
    (4, LONG, "en", "b", len(LONG)),
    (5, "x" * 100_000, "en", "b", 100_000),
    (6, "one two three", "en", "a", 13),
    (7, "one two three", "en", "a", 13),
    (7, "one two three", "en", "a", 13),
    (8, "ÄÖÜ ß 😀 mail a.b@c.de or 10.0.0.1, MIT License", "de", None, 40),
    (9, "!!! ??? ...", "en", "", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and clashing further columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, COLUMNS).select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    """Empty documents."""
    return spark.createDataFrame([], COLUMNS)
