"""One row per key, in the several senses the marts need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = str | Column


def _ordering(order: Sequence[Order], nulls: str) -> list[Column]:
    if nulls not in ("first", "last"):
        raise ValueError(f"nulls must be 'first' or 'last', not {nulls!r}")
    newest = F.desc_nulls_first if nulls == "first" else F.desc_nulls_last
    return [newest(o) if isinstance(o, str) else o for o in order]


def _names(x: Sequence[str] | str) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Order] | Order,
    tie_break: Sequence[Order] = (),
    nulls: str = "last",
) -> DataFrame:
    """The newest row of every key.

    Names in ``order`` sort newest first; a column expression brings its own direction.  ``tie_break``
    sorts ascending by name and should make the choice unique.  Spark turns the filter on the row number
    into a per-key limit that runs on the map side, so a hot key ships one row per input task.
    """
    order = [order] if isinstance(order, str | Column) else list(order)
    ties = [F.asc_nulls_last(t) if isinstance(t, str) else t for t in tie_break]
    window = Window.partitionBy(*_names(keys)).orderBy(*_ordering(order, nulls), *ties)
    return df.withColumn("_pick", F.row_number().over(window)).where("_pick = 1").drop("_pick")


def top_rank_per_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Order] | Order, nulls: str = "last") -> DataFrame:
    """All rows tied on the newest value of every key; limited per key on the map side as well."""
    order = [order] if isinstance(order, str | Column) else list(order)
    window = Window.partitionBy(*_names(keys)).orderBy(*_ordering(order, nulls))
    return df.withColumn("_pick", F.rank().over(window)).where("_pick = 1").drop("_pick")


def keep_singletons(df: DataFrame, key: str) -> DataFrame:
    """Keys that have exactly one distinct row; every row of any other key is dropped, NULL keys too.

    Two partial aggregations: copies collapse first, then the key keeps a count and one row.
    """
    rest = [c for c in df.columns if c != key]
    variants = df.where(F.col(key).isNotNull()).distinct()
    one = variants.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    return one.where("_n = 1").select(*[F.col("_row")[c].alias(c) if c != key else F.col(key) for c in df.columns])
