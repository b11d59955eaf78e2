"""Data checks that gate publication. Each check yields a number of violations; 0 passes.

Each fact is read once: rows are counted per key, the dimensions are looked up for the keys, and one aggregate holds what all
checks of that fact need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["date_key", "store_key", "item_key"]
EXACT = "decimal(38,6)"  # the sum of doubles depends on the order of addition


class ChecksFailed(RuntimeError):
    """Raised before anything is published when a check has violations."""


def _whole(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def fact_measures(fact: DataFrame, dimensions: dict[str, DataFrame], units: str | None = None) -> DataFrame:
    """One row about a fact: ``rows``; ``duplicates``, rows beyond the first of their key, all of them where a part of the key
    is missing; ``orphans_<key>``, rows whose key the dimension lacks; ``units``, the exact total of that column."""
    total = F.sum(F.col(units).cast(EXACT)) if units else F.lit(None).cast(EXACT)
    keyed = fact.groupBy(*KEY).agg(F.count("*").alias("n"), total.alias("units"))
    for key, dimension in dimensions.items():
        keyed = keyed.join(dimension.select(key).distinct().withColumn(f"has_{key}", F.lit(True)), key, "left")
    incomplete = reduce(Column.__or__, [F.col(c).isNull() for c in KEY])
    n = F.col("n")
    return keyed.agg(
        _whole(n).alias("rows"),
        _whole(F.when(incomplete, n).otherwise(n - 1)).alias("duplicates"),
        F.sum("units").alias("units"),
        *[_whole(F.when(F.col(f"has_{key}").isNull(), n)).alias(f"orphans_{key}") for key in dimensions],
    )


def dq_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks as one table (check, violations)."""
    stores, items, dates = (tables[t] for t in ("stg_store", "stg_item", "dim_date"))
    sales = tables["sales"].agg(F.count("*").alias("rows"), F.sum(F.col("units").cast(EXACT)).alias("units"))
    measured = {
        "sales": sales,
        "fact": fact_measures(tables["fact_sales"], {"store_key": stores, "item_key": items, "date_key": dates}, "units"),
        "risk": fact_measures(tables["fact_stockout_risk"], {"date_key": dates}),
    }
    one_row_each = [df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns}) for name, df in measured.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_each)
    c = {name: F.col(name) for name in stacked.columns}
    # The names under which the checks report.
    violations = {
        "fact_sales_duplicate_keys": c["fact_duplicates"],
        "fact_stockout_risk_duplicate_keys": c["risk_duplicates"],
        "fact_sales_orphan_store": c["fact_orphans_store_key"],
        "fact_sales_orphan_item": c["fact_orphans_item_key"],
        "fact_sales_orphan_date": c["fact_orphans_date_key"],
        "fact_stockout_risk_orphan_date": c["risk_orphans_date_key"],
        "rows_silver_vs_gold": F.abs(c["sales_rows"] - c["fact_rows"]),
        "units_silver_vs_gold": F.when(c["sales_units"].eqNullSafe(c["fact_units"]), 0).otherwise(1),
    }
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), value.cast("bigint").alias("violations")) for name, value in violations.items()
    ])))


def failing(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("violations") > 0)


def require_clean(checks: DataFrame) -> None:
    """Raise when any check has violations. One row per check reaches the driver."""
    bad = {row["check"]: row["violations"] for row in failing(checks).collect()}
    if bad:
        raise ChecksFailed(f"data checks failed, nothing published: {bad}")
