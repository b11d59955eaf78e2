"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of 60 bits (of its id and text). A source takes whole rounds of all its documents plus, for the
rest of its budget, the documents whose hash lies below a threshold. The threshold is found without sorting: sizes are
summed by source and hash bucket, the running sum names the bucket in which the budget ends, and only that bucket is
refined with the next digits of the hash, until it holds one hash. Thresholds nest: a larger budget keeps every document
that a smaller one took.

Each level reads a narrow table (source, hash, size), keeps the rows of one bucket per source, and shuffles at most 4,096
sums per source and task. A source that owns a third of all rows is no harder than any other.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; empty documents are taken 0
words. The document in which the budget ends is taken if that comes nearer to the budget. Repeated rows (same id and text)
share one hash: if the budget ends among them they share it evenly, in words. A source without words has target 0. An
empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import TOKEN, text_of

WEIGHTS = (3, 1, 2)       # by position of the source, repeating
SHARE = 1.5               # of all words
MOST = 2                  # times its own size that a source or document may give
DIGITS = 15               # hexadecimal digits of the hash
LEVEL_DIGITS = 3          # of them, refined at each level


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def document_hash() -> Column:
    """60 bits of the md5 of id and text."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of())
    return F.conv(F.substring(F.md5(both), 1, DIGITS), 16, 10).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target.

    Filling up by weight with a cap is one level for all: target = min(cap, weight * level). Sources in order of the level
    that fills them are full up to some rank; the level follows from what is left for the others.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row per source
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    cap, weight = (MOST * F.col("source_size")).cast("double"), F.col("weight")
    upto = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("rank", rank)
        .withColumn("weight", F.get(weights, (F.col("rank") - 1) % len(WEIGHTS)))
        .withColumns({"cap": cap, "fills_at": cap / weight})
        .withColumns({
            "capped_before": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(upto), F.lit(0)),
            "budget": SHARE * F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
        })
        # the level if exactly the sources before this one are full; from the first source that is not full on they fall
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything))
    )
    return ranked.select("source", "source_size", F.least(cap, weight * F.col("level")).alias("target"))


def _leading(digits: int) -> Column:
    """The first digits of the hash, as a number."""
    return F.shiftright("hash", 4 * (DIGITS - digits))


def _rounds() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source that ends amid a bucket: source as ``s``, the bucket's leading digits (``edge``, ``digits`` of
    them), what the budget leaves for it (``left``), its size (``inside``) and its ``rows``.

    Refines until every such bucket holds one row, or has one hash.
    """
    filled = sized.filter(F.col("size") > 0)
    state = targets.filter(F.col("source_size") > 0).select(
        F.col("source").alias("s"), (F.col("target") - _rounds() * F.col("source_size")).alias("left"),
        F.lit(0).cast("bigint").alias("edge"))
    upto = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    for digits in range(LEVEL_DIGITS, DIGITS + 1, LEVEL_DIGITS):
        cells = (
            filled.join(state.select("s", "edge"), F.col("source").eqNullSafe(F.col("s"))
                        & (_leading(digits - LEVEL_DIGITS) == F.col("edge")))
            .groupBy("s", _leading(digits).alias("cell")).agg(F.sum("size").alias("inside"), F.count("*").alias("rows"))
            .withColumn("before", F.coalesce(F.sum("inside").over(upto), F.lit(0)))  # at most 4,096 rows a source
        )
        state = store(
            cells.join(state.select(F.col("s").alias("t"), "left"), F.col("s").eqNullSafe(F.col("t")))
            .filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("inside")))
            .select("s", F.col("cell").alias("edge"), (F.col("left") - F.col("before")).alias("left"), "inside", "rows"),
            "mix-edges",
        )
        if not state.filter(F.col("rows") > 1).head(1):
            break
    return state.withColumn("digits", F.lit(digits))


def _budgets(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target and where its budget ends (null where it ends with a whole round). Written."""
    targets = store(source_targets(sized), "mix-targets")
    edges = thresholds(sized, targets)
    return store(targets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                 .withColumnRenamed("source", "_of"), "mix-budgets")


def _taken(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Add source_size, target and taken to rows with source, size and hash."""
    cell = F.expr(f"shiftright(hash, 4 * ({DIGITS} - digits))")
    extra = (
        F.when(F.col("edge").isNull() | (cell > F.col("edge")), 0)
        .when(cell < F.col("edge"), F.col("size"))
        .when(F.col("rows") == 1, F.when(2 * F.col("left") >= F.col("inside"), F.col("size")).otherwise(0))
        .otherwise(F.floor(F.col("size") * F.col("left") / F.col("inside")))
    )
    return (
        sized.join(budgets, F.col("source").eqNullSafe(F.col("_of")))
        .withColumn("taken", (_rounds() * F.col("size") + extra).cast("bigint"))
        .select(*sized.columns, "source_size", "target", "taken")
    )


def _sized(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(*more, "source", words_in(text_of()).alias("size"), document_hash().alias("hash"))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of its words the mix takes, repeats counted."""
    sized = store(_sized(documents, "doc_id"), "mix-sizes")
    return _taken(sized, _budgets(sized)).drop("source", "hash")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them (rounded, 0 to 2 times), with their own columns. Empty ones cost nothing
    and stay once. Where the table of budgets is small, as it is unless sources are many, texts are not shuffled."""
    budgets = _budgets(store(_sized(documents), "mix-sizes"))
    whole = documents.select(F.struct("*").alias("_row"), "source", "doc_id", "text")
    sized = whole.select("_row", "source", words_in(text_of()).alias("size"), document_hash().alias("hash"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return (
        _taken(sized, budgets).withColumn("_times", times).filter("_times > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
    )
