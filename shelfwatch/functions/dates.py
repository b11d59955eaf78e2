"""Date keys and calendar attributes as plain integer arithmetic (stays in generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_key(day: Column | str) -> Column:
    """yyyymmdd as INT."""
    d = _col(day)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_date(key: Column | str) -> Column:
    """The DATE behind a yyyymmdd key."""
    k = _col(key).cast("int")
    return F.make_date((k / 10000).cast("int"), ((k / 100) % 100).cast("int"), (k % 100).cast("int"))


def week_start(day: Column | str) -> Column:
    """Monday of the day's ISO week. Pure date arithmetic, so no session time zone is involved."""
    d = _col(day)
    return F.date_sub(d, F.weekday(d))


def is_payday(day: Column | str) -> Column:
    """Wages are paid on the 15th and on the last day of the month."""
    d = _col(day)
    return (F.dayofmonth(d) == 15) | (d == F.last_day(d))
