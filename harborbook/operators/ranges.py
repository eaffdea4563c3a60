"""Values that depend on the rows before, where one key, or one key and period, may hold most rows.

A window by key sends all rows of a key to one task.  Here rows are dealt out by ranges of (key, order), so a large key
lies in several neighbouring parts of about equal size; work is done inside each part, and what a part has to know of those
before it is handed on by key.  A part begins with one key at most that began before, so what is handed on has fewer rows
than there are parts; that bounds the side that is broadcast.  The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.operators.lineage import settle


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Written rows with ``_part``, the number of their range, and ``_key``, the keys as one value (NULL is a value like any other).

    Ranges follow (keys, order), NULL first.  Rows that are equal in all of these lie in one part, so ``order`` should tell
    the rows of a key apart.
    """
    dealt = df.repartitionByRange(*[F.asc_nulls_first(c) for c in [*keys, *order]])
    return settle(dealt.select("*", F.spark_partition_id().alias("_part"), F.struct(*keys).alias("_key")), "ranges")


def handed_on(per_part: DataFrame, value: Column) -> DataFrame:
    """(_part, _key, _before): ``value``, a window expression over the parts of a key, where a part has others before it."""
    return per_part.select("_part", "_key", value.alias("_before")).where(F.col("_before").isNotNull())


def _join_handed(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(before), ["_part", "_key"], "left")  # fewer rows than parts


def previous_values(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``_prior``, a struct of ``columns`` of the row before in the order of a key; NULL for the first."""
    values, by = F.struct(*columns), [F.asc_nulls_first(c) for c in order]
    rows = in_ranges(df, [key], order)
    last = rows.groupBy("_part", "_key").agg(F.max_by(values, F.struct(*order)).alias("_last"))
    chain = Window.partitionBy("_key").orderBy("_part")
    before = handed_on(last, F.lag("_last").over(chain))
    inside = Window.partitionBy("_part", "_key").orderBy(*by)
    rows = _join_handed(rows.withColumn("_sibling", F.lag(values).over(inside)), before)
    return rows.select(*df.columns, F.coalesce("_sibling", "_before").alias("_prior"))


def running_total_of_rows(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, columns: Mapping[str, str]) -> DataFrame:
    """Running sum of ``columns = {column: name of its sum}`` per key in two levels: sums of parts, and sums inside a part.

    For any number of rows per key; ``order`` should tell the rows of a key apart.  As in a window, NULL adds nothing, and
    sums are NULL until the first value.
    """
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    rows = in_ranges(df, keys, order)
    totals = rows.groupBy("_part", "_key").agg(*[F.sum(c).alias(n) for c, n in columns.items()])
    chain = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("_part").over(Window.partitionBy("_key"))
    sums = F.when(F.col("_part") > first, F.struct(*[F.sum(n).over(chain).alias(n) for n in columns.values()]))
    before = handed_on(totals, sums)
    inside = Window.partitionBy("_part", "_key").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = _join_handed(rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for c, n in columns.items()]), before)

    types = dict(rows.dtypes)

    def both(name: str) -> Column:
        own, other = F.col(f"_in_{name}"), F.col("_before")[name]
        return F.when(other.isNull(), own).when(own.isNull(), other).otherwise(own + other).cast(types[f"_in_{name}"]).alias(name)

    return rows.select(*df.columns, *[both(n) for n in columns.values()])
