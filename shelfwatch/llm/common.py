"""Column expressions and sampling that several corpus operators share."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a word. Everything outside ASCII is part of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"                    # in text whose A-Z are lower-cased
WORD_EITHER_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words in any text
TOKEN = r"[^\x20\x09-\x0D]+"                                  # a run without blanks

BATCH_TEXTS = 1000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_of(c: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table. From now on the session hands at most ``BATCH_TEXTS`` rows at a time to Python workers, so that long
    texts fit; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_TEXTS:
        df.sparkSession.conf.set(setting, str(BATCH_TEXTS))
    return df


def spread_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deal rows to tasks by group for ``groupBy(*keys).applyInPandas``, over all shuffle partitions: comparing takes long for
    few bytes, so partitions must not be merged by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_few_files(df: DataFrame, column: str) -> DataFrame:
    """A table of a few numbers per row in fewer pieces, dealt by ``column``: an eighth of the shuffle partitions, or more
    where AQE finds them larger than its advisory size. What made the table keeps all its tasks."""
    return df.hint("rebalance", max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8), column)


def hashed_share(df: DataFrame, key: Column, rows: int, total: int | None = None) -> DataFrame:
    """At most ``rows`` rows and nearly as many, chosen by the hash of a key that tells rows apart: the same rows in every
    run, taken where they lie, no sort.

    All rows if there are no more than that. Counts the table first unless ``total`` is given. The share lies six standard
    deviations of the draw below ``rows``, and is a fraction of 2^53, fine enough for tables of any size.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    share = max(rows - 6 * math.sqrt(rows), rows / 4) / total
    return df.filter(F.pmod(F.xxhash64(key), F.lit(2**53)) / 2**53 < share)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``rows`` labelled documents that are not held out, one for each id.

    Labels that are null or neither 0 nor 1 teach nothing; of several labels of one id the larger holds, of several texts
    the one with the smallest digest; rows with a null id or text are left out.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    texts = in_small_batches(documents).select("doc_id", "text").filter(F.col("text").isNotNull())
    return (
        hashed_share(known, F.col("doc_id"), rows).join(texts, "doc_id")
        .groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))  # an id that many rows share is one row a task
    )
