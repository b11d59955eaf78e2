"""Bootstrap intervals of the median without resampling the values.

The median of a resample of n values is one order statistic (two for even n) of n uniform index
draws, and uniform order statistics follow Beta distributions. So a replicate needs one or two draws
of a *rank*, not n draws of a value, and the values only have to be looked up at the drawn ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.ranking import RankIndex, medians, rank_index, values_at
from shelfwatch.functions.workers import importable
from shelfwatch.params import Params

# metric name in the summary -> column of the event table
METRICS = {"uplift": "uplift", "dip": "post_dip", "net": "net_lift"}


def median_ranks(n: int, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """1-based ranks of the two middle values of ``draws`` resamples of n values (equal for odd n)."""
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, draws)
    if n % 2:
        high = low
    else:
        # the next uniform above the k-th: the minimum of the n - k that lie beyond it
        high = 1 - (1 - low) * rng.random(draws) ** (1 / (n - k))
    ranks = [np.minimum((n * u).astype("int64"), n - 1) + 1 for u in (low, high)]
    return ranks[0], ranks[1]


def _rank_draws(sizes: DataFrame, groups: list[str], resamples: int, seed: int) -> DataFrame:
    """``resamples`` rank pairs per group. The stream is seeded by the group's own key, so the result
    does not depend on how groups are spread over tasks.

    Meant for groups that are few against the rows, such as families: a group costs ``resamples`` draws and twice as many
    rows in the lookup, however many values it holds.
    """
    importable(sizes.sparkSession)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                key = "\x1f".join(str(row[g]) for g in groups)
                stream = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
                low, high = median_ranks(int(row["n"]), resamples, np.random.default_rng([seed, stream]))
                yield pd.DataFrame({
                    **{g: row[g] for g in groups},
                    "replicate": np.arange(resamples, dtype="int32"), "low": low, "high": high,
                })

    fields = ", ".join(f"`{g}` {sizes.schema[g].dataType.simpleString()}" for g in groups)
    return sizes.select(*groups, "n").mapInPandas(draw, f"{fields}, replicate INT, low BIGINT, high BIGINT")


def median_intervals(index: RankIndex, resamples: int, seed: int, min_rows: int = 1) -> DataFrame:
    """Median with a percentile-bootstrap 95% interval per group: groups, median, lo, hi.

    Groups with fewer than ``min_rows`` values are left out. The work in Python is ``resamples`` draws
    per group, whatever the group's size.
    """
    groups, n, replicate = index.groups, F.col("n"), F.col("replicate")
    sizes = index.sizes().filter(n >= min_rows)
    # replicate -1 asks for the plain median, so that one lookup serves everything
    plain = sizes.select(
        *groups, F.lit(-1).alias("replicate"), F.floor((n + 1) / 2).alias("low"), (F.floor(n / 2) + 1).alias("high"))
    wanted = _rank_draws(sizes, groups, resamples, seed).unionByName(plain).select(
        *groups, "replicate", F.explode(F.array("low", "high")).alias("rank"))
    middles = values_at(index, wanted).groupBy(*groups, "replicate").agg(F.avg("value").alias("middle"))
    return (
        middles.groupBy(*groups).agg(
            F.max(F.when(replicate < 0, F.col("middle"))).alias("median"),
            # bounded: one value per replicate
            F.percentile(F.when(replicate >= 0, F.col("middle")), [0.025, 0.975]).alias("ci"),
        )
        .select(*groups, "median", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))
    )


def bootstrap_median_ci(df: DataFrame, groups: list[str], value: str, resamples: int, seed: int) -> DataFrame:
    """``median_intervals`` of a plain column. NULL values are ignored."""
    return median_intervals(rank_index(df, groups, value), resamples, seed)


def order_intervals(index: RankIndex, min_rows: int = 1, widths: float = 1.96) -> DataFrame:
    """Median with an interval of two order statistics per group: groups, median, lo, hi.

    How many of n values lie below the median is binomial, so the order statistics about ``widths`` * sqrt(n) / 2 ranks
    from the middle enclose it. Free of draws, and what the bootstrap comes to for large n.
    """
    groups, n = index.groups, F.col("n")
    half = F.lit(widths) * F.sqrt(n) / 2
    ends = {"lo": F.greatest(F.floor(n / 2 - half), F.lit(1)), "hi": F.least(F.ceil(n / 2 + half) + 1, n)}
    wanted = index.sizes().filter(n >= min_rows).select(
        *groups, "n", F.explode(F.create_map(*[x for k, v in ends.items() for x in (F.lit(k), v.cast("bigint"))])).alias("end", "rank"))
    found = values_at(index, wanted).groupBy(*groups).agg(
        *[F.max(F.when(F.col("end") == e, F.col("value"))).alias(e) for e in ends])
    return medians(index, min_rows).select(*groups, "median").join(found, groups)


def reach(n: int, middle: int, k: int) -> float:
    """Chance that the ``middle``-th smallest of n values drawn with replacement is at most the k-th smallest of the n: that
    at least ``middle`` of n draws hit the first k. Sums the binomial terms within 40 standard deviations of their mean, each
    from the one before."""
    if k >= n:
        return 1.0
    p = k / n
    width = int(40 * (n * p * (1 - p)) ** 0.5) + 40
    hits = np.arange(max(0, int(n * p) - width), min(n, int(n * p) + width) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - hits[:-1]) / hits[1:]) + np.log(p / (1 - p)))])
    terms = np.exp(logs - logs.max())
    return float(terms[hits >= middle].sum() / terms.sum())


def reached_rank(n: int, middle: int, q: float) -> int:
    """The smallest k whose ``reach`` is at least q: the rank of the q-quantile of that order statistic's distribution."""
    low, high = 1, n
    while low < high:
        k = (low + high) // 2
        low, high = (low, k) if reach(n, middle, k) >= q else (k + 1, high)
    return low


ENDS = {"lo": 0.025, "hi": 0.975}


def bound_ranks(n: int, resamples: int, widths: float) -> list[int]:
    """Ranks that the ends of the interval of ``resamples`` resamples lie between: least and most of lo, then of hi.

    The share of resamples below a true q-quantile varies by sqrt(q (1 - q) / resamples), so the end lies between the true
    quantiles ``widths`` of those (and one resample, for interpolation) to either side. The median of a resample lies between
    its two middle values, so the least rank comes from the lower and the most from the upper one.
    """
    out = []
    for q in ENDS.values():
        off = widths * (q * (1 - q) / resamples) ** 0.5 + 1 / resamples
        out += [reached_rank(n, (n + 1) // 2, max(q - off, 0.0)), reached_rank(n, n // 2 + 1, min(q + off, 1.0))]
    return out


def interval_bounds(events: DataFrame, p: Params, widths: float = 4.0) -> DataFrame:
    """Whether each end of the bootstrap intervals lies where the exact distribution of the resampled median puts it, per
    family and metric: n, the values it must lie between, and whether it does.

    Ranks cost a few binomial sums per group, whatever its size a few square roots of n; their values are looked up.
    """
    importable(events.sparkSession)
    index, counts = _metric_values(events, p)
    resamples = p.bootstrap_resamples

    @F.pandas_udf("array<bigint>")
    def ranks(sizes: pd.Series) -> pd.Series:
        return pd.Series([bound_ranks(int(n), resamples, widths) for n in sizes])

    names = [f"{end}_{side}" for end in ENDS for side in ("least", "most")]
    sizes = index.sizes().filter(F.col("n") >= p.min_family_events)
    wanted = sizes.select("family", "metric", "n", F.posexplode(ranks("n")).alias("at", "rank"))
    found = values_at(index, wanted).groupBy("family", "metric", "n").agg(
        *[F.max(F.when(F.col("at") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])
    drawn = median_intervals(index, resamples, p.seed, p.min_family_events).drop("median")
    return (
        found.join(drawn, ["family", "metric"]).join(counts.select("family"), "family", "left_semi")
        .select("family", "metric", "n", *names,
                *[F.col(end).between(F.col(f"{end}_least"), F.col(f"{end}_most")).alias(f"{end}_within") for end in ENDS])
    )


def _metric_values(events: DataFrame, p: Params) -> tuple[RankIndex, DataFrame]:
    """(family, metric) values, written in one pass over the events, and the families with enough events."""
    stacked = events.filter(F.col("family").isNotNull()).select(
        "family",
        F.explode(F.create_map(*[x for m, c in METRICS.items() for x in (F.lit(m), F.col(c))])).alias("metric", "v"),
    )
    index = rank_index(stacked, ["family", "metric"], "v")
    # every event has one row per metric, NULL or not
    count_of = lambda metric, known: F.coalesce(
        F.sum(F.when((F.col("metric") == metric) & known, F.col("ties"))), F.lit(0))
    there = F.col("value").isNotNull()
    counts = index.values.groupBy("family").agg(
        count_of("uplift", F.lit(True)).alias("n_events"),
        count_of("dip", there).alias("n_dip_events"), count_of("net", there).alias("n_net_events"),
    )
    return index, counts.filter(F.col("n_events") >= p.min_family_events)


def _family_table(counts: DataFrame, estimates: DataFrame, columns: list[str]) -> DataFrame:
    """Spread (family, metric) estimates over columns, beside the number of values behind each."""
    spread = estimates.groupBy("family").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in columns
    ])
    return counts.join(spread, "family", "left").select(
        "family",
        "n_events", *[f"uplift_{c}" for c in columns],
        "n_dip_events", *[f"dip_{c}" for c in columns],
        "n_net_events", *[f"net_{c}" for c in columns],
    ).orderBy(F.desc("uplift_median"), "family")


def family_summary(events: DataFrame, p: Params, interval: str = "bootstrap") -> DataFrame:
    """Median uplift, post-promotion dip and net lift per family with 95% intervals: "bootstrap", or "order" for those of
    order statistics.

    Families with too few events are skipped. Dip and net lift exist only for events with a quiet week
    after, so they have their own counts and are NULL below the minimum. Best uplift first.
    """
    index, counts = _metric_values(events, p)
    if interval == "bootstrap":
        intervals = median_intervals(index, p.bootstrap_resamples, p.seed, p.min_family_events)
    elif interval == "order":
        intervals = order_intervals(index, p.min_family_events)
    else:
        raise ValueError(f"interval must be 'bootstrap' or 'order', not {interval!r}")
    return _family_table(counts, intervals, ["median", "lo", "hi"])


def family_medians(events: DataFrame, p: Params) -> DataFrame:
    """The medians of ``family_summary`` alone, without the intervals."""
    index, counts = _metric_values(events, p)
    return _family_table(counts, medians(index, p.min_family_events), ["median"])


def interval_brackets(events: DataFrame, p: Params, widths: float = 4.0) -> DataFrame:
    """Whether the bootstrap intervals lie where they must, per family and metric: around the median, and within the order
    statistics ``widths`` standard deviations of rank from the middle. n, median and those two are exact."""
    index, counts = _metric_values(events, p)
    drawn = median_intervals(index, p.bootstrap_resamples, p.seed, p.min_family_events)
    outer = order_intervals(index, p.min_family_events, widths).select(
        "family", "metric", F.col("lo").alias("outer_lo"), F.col("hi").alias("outer_hi"))
    return (
        drawn.join(outer, ["family", "metric"]).join(index.sizes(), ["family", "metric"])
        .join(counts.select("family"), "family", "left_semi")
        .select("family", "metric", "n", "median", "outer_lo", "outer_hi",
                F.col("median").between(F.col("lo"), F.col("hi")).alias("holds_median"),
                (F.col("lo") >= F.col("outer_lo")).alias("lo_inside"), (F.col("hi") <= F.col("outer_hi")).alias("hi_inside"))
    )
