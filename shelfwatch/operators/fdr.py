"""Benjamini–Hochberg false-discovery control over any number of tests.

Ranks the logarithm of the p-values: it keeps apart what ``exp`` would round to 0, and decimal places of a logarithm are
relative places of the p-value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.ranking import RankIndex, rank_index


def _contenders(runs: DataFrame, q: float, logs: list[str]) -> RankIndex:
    """(test, value, ties) per column of log p-values. No rank exceeds m, so only values up to log q can pass (kept with a
    hair of slack for rounding); all others fall into one NULL row that still counts towards m."""
    tests = F.create_map(*[x for name in logs for x in (F.lit(name), F.col(name))])
    stacked = runs.select(F.explode(tests).alias("test", "log_p"))
    return rank_index(stacked, ["test"], F.when(F.col("log_p") <= math.log(q) + 1e-9, F.col("log_p")))


def _cutoffs(contenders: RankIndex, q: float) -> DataFrame:
    """test, m, cutoff: the largest log p(i) with p(i) <= i * q / m, NULL when no test passes.

    Equal values share the highest rank among them, which is the rank the step-up rule uses.
    """
    totals = contenders.values.groupBy("test").agg(F.sum("ties").alias("m"))  # one row per test
    passing = (
        contenders.ranks().join(F.broadcast(totals), "test")
        .filter(F.col("value") <= F.ln(F.col("last_rank") * F.lit(q) / F.col("m")))
        .groupBy("test").agg(F.max("value").alias("cutoff"))
    )
    return totals.join(passing, "test", "left")


def bh_cutoff(runs: DataFrame, q: float, log_p: str = "ln_p_value") -> DataFrame:
    """The Benjamini–Hochberg cut-off of the log p-values as a one-row table; NULL when nothing passes."""
    return _cutoffs(_contenders(runs, q, [log_p]), q).agg(F.max("cutoff").alias("cutoff"))


def flag_bh(runs: DataFrame, q: float, log_p: str = "ln_p_value") -> tuple[DataFrame, DataFrame]:
    """Runs with ``is_flagged``, and the one-row cut-off table.

    Reads ``runs`` once for the cut-off, when called, and once more in the result. The cut-off enters
    as a scalar subquery and does not pass through the driver.
    """
    cutoff = bh_cutoff(runs, q, log_p)
    flag = F.coalesce(F.col(log_p) <= cutoff.scalar(), F.lit(False))
    return runs.withColumn("is_flagged", flag), cutoff


def bh_summary(runs: DataFrame, q: float) -> DataFrame:
    """One row: tests, flags, the cut-off as a p-value, how many flags may be chance, and what a plain Poisson test of
    the same runs would have flagged. One pass over the runs serves both tests."""
    contenders = _contenders(runs, q, ["ln_p_value", "ln_p_poisson"])
    nb, poisson = F.col("test") == "ln_p_value", F.col("test") == "ln_p_poisson"
    passes = F.when(F.col("value") <= F.col("cutoff"), F.col("ties")).otherwise(0)
    return (
        contenders.values.join(F.broadcast(_cutoffs(contenders, q)), "test")  # one row per test
        .agg(
            F.coalesce(F.sum(F.when(nb, F.col("ties"))), F.lit(0)).alias("tested_runs"),
            F.coalesce(F.sum(F.when(nb, passes)), F.lit(0)).alias("flagged_runs"),
            F.exp(F.max(F.when(nb, F.col("cutoff")))).alias("bh_cutoff"),
            F.coalesce(F.sum(F.when(poisson, passes)), F.lit(0)).alias("poisson_flagged_runs"),
        )
        .select("tested_runs", "flagged_runs", "bh_cutoff",
                (F.col("tested_runs") * F.coalesce("bh_cutoff", F.lit(0.0))).alias("max_chance_flags"),
                "poisson_flagged_runs")
    )
