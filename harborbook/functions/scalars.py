"""Small column expressions; all are built-in Spark functions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yyyymm(c: Column | str) -> Column:
    """Month of a date as the integer 202406."""
    c = as_col(c)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Calendar days from ``start`` to ``end``; the time of day plays no part."""
    return F.datediff(as_col(end).cast("date"), as_col(start).cast("date"))


def nz(c: Column | str) -> Column:
    """NULL becomes 0."""
    return F.coalesce(as_col(c), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_part(c: Column | str, separator: str = "|") -> Column:
    return F.split_part(as_col(c), F.lit(separator), F.lit(1))


def zip5(c: Column | str) -> Column:
    """Last five characters after left-padding with zeros, so ``123`` is ``00123`` and a ZIP+4 gives ``-6789``."""
    return F.right(F.concat(F.lit("00000"), as_col(c)), F.lit(5))


def text_like_zero(c: Column | str) -> Column:
    """Numeric zero written as text in any way, or the empty text."""
    c = as_col(c)
    return F.coalesce(c.try_cast("int") == 0, F.lit(False)) | F.coalesce(c == "", F.lit(False))


def capped(c: Column | str, limit: int) -> Column:
    """``limit`` where the value is larger; NULL stays NULL (``least`` would give the limit)."""
    c = as_col(c)
    return F.when(c > limit, F.lit(limit)).otherwise(c)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def fraction_of(days: Column, precision: str = "decimal(10,6)") -> Column:
    """Days as a share of a 365-day year."""
    return (days / F.lit(365).cast("decimal(10,6)")).cast(precision)
