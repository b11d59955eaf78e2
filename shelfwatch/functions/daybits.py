"""Sets of days as bitmaps: one row per key instead of one row per key and day.

A word holds 64 days; word w covers the day numbers 64 w to 64 w + 63 (day number: days since 1970-01-01). A key's words lie
in one array from its first to its last word, so ten years are 57 numbers. Looking up a day or counting the days of a range
is arithmetic on the row, so tables that ask are neither exploded to days nor exchanged by day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store


def _bit(day: Column) -> Column:
    return day.bitwiseAND(F.lit(63)).cast("int")


def _word(day: Column) -> Column:
    return F.shiftright(day, 6)


@dataclass(frozen=True)
class DayBits:
    """``table``: key, first_word and an array of words per set; ``size``: its bytes.

    The expressions refer to the columns by name. A select that uses them must not give the name of a set to another column,
    for Spark would take that one (a lateral alias).
    """

    table: DataFrame
    key: str
    size: int

    def has(self, name: str, day: Column) -> Column:
        """Whether the day (number) is in the set ``name`` of the row's key."""
        word = F.get(F.col(name), _word(day) - F.col("first_word"))
        return F.coalesce(F.getbit(word, _bit(day)) == 1, F.lit(False))

    def between(self, name: str, first: Column, last: Column) -> Column:
        """The days (numbers, in order) of the set from ``first`` to ``last``, both included."""
        return F.filter(F.sequence(first, last), lambda day: self.has(name, day))

    def count(self, name: str, first: Column, last: Column) -> Column:
        """How many days of the set lie from ``first`` to ``last``, both included; a word at a time."""

        def inside(word: Column) -> Column:
            bits = F.coalesce(F.get(F.col(name), word - F.col("first_word")), F.lit(0).cast("bigint"))
            above = F.when(word == _word(first), _from(_bit(first))).otherwise(F.lit(-1).cast("bigint"))
            below = F.when(word == _word(last), _upto(_bit(last))).otherwise(F.lit(-1).cast("bigint"))
            return F.bit_count(bits.bitwiseAND(above).bitwiseAND(below))

        return F.aggregate(F.sequence(_word(first), _word(last)), F.lit(0), lambda total, word: total + inside(word))

    def beside(self, df: DataFrame, keys: list[str], pairs: DataFrame, how: str = "inner") -> DataFrame:
        """``df`` with the words of each row's key, without exchanging ``df`` by that key, which may be skewed.

        ``keys``: what ``df`` is partitioned by; ``pairs``: a table with (at least) all their values. Below the session's
        broadcast threshold the words are broadcast. Above it they are brought to the key combinations first, which are
        then joined on all keys: an exchange of one row per combination instead of one of ``df``.
        """
        if self.size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
            return df.join(F.broadcast(self.table), self.key, how)
        return df.join(pairs.select(*keys).distinct().join(self.table, self.key), keys, how)


def _from(bit: Column) -> Column:
    """All bits from ``bit`` on."""
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), bit)


def _upto(bit: Column) -> Column:
    """All bits up to ``bit``."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(63) - bit)


def day_bits(days: DataFrame, key: str, **sets: Column) -> DayBits:
    """Bitmaps per ``key`` over the rows of ``days`` (a ``date`` each): one set for each condition given."""
    day = F.unix_date("date")
    words = days.groupBy(key, _word(day).alias("word")).agg(*[
        F.bit_or(F.when(condition, F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(day))).otherwise(0)).alias(name)
        for name, condition in sets.items()])
    every = words.groupBy(key).agg(
        F.min("word").alias("first_word"), F.max("word").alias("last_word"),
        *[F.map_from_entries(F.collect_list(F.struct("word", name))).alias(name) for name in sets])

    def in_order(name: str) -> Column:
        return F.transform(F.sequence("first_word", "last_word"),
                           lambda word: F.coalesce(F.element_at(name, word), F.lit(0).cast("bigint"))).alias(name)

    table = store(every.select(key, "first_word", *[in_order(name) for name in sets]), "day-bits")
    size = table.agg(F.sum(F.lit(16) + sum(8 * F.size(name) for name in sets))).head()[0]
    return DayBits(table, key, size or 0)
