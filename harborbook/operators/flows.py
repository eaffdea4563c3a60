"""Transactions to months, running totals, cumulative values to changes, exposure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.functions import days_between, fraction_of, nz, yyyymm
from harborbook.operators.ranges import previous_values


def monthly_amounts(tx: DataFrame, key: str, date_col: str, measures: Mapping[str, Column]) -> DataFrame:
    """Sums per key and month; rows without a key are left out, NULL amounts count as 0."""
    dated = tx.where(F.col(key).isNotNull()).withColumn("eval_date", yyyymm(date_col))
    return dated.groupBy(key, "eval_date").agg(*[nz(F.sum(m)).alias(n) for n, m in measures.items()])


def monthly_flow(tx: DataFrame, key: str, date_col: str, measures: Mapping[str, Column], spine: DataFrame) -> DataFrame:
    """Amount and running total per key and month of the spine, 0 where nothing happened.

    Transactions are summed per key and month, packed per key and only then laid out over the spine, so
    the key-by-month grid is never shuffled: the running window finds it partitioned by ``key`` already.
    Transactions of months off the spine count in no month, not in the running total either.
    """
    names = list(measures)
    monthly = monthly_amounts(tx, key, date_col, measures)
    packed = pack_months(monthly, key, names, spine, "_flow")
    return unpack_flow(packed.crossJoin(F.broadcast(spine)), key, names, "_flow").drop("_flow")


def pack_months(monthly: DataFrame, key: str, values: Sequence[str], spine: DataFrame, name: str) -> DataFrame:
    """One row per key with a map from month to its values (empty for a key without a month on the spine).

    ``monthly`` has one row per key and month, and months off the spine become NULL before the
    collection, so a map is never longer than the spine.
    """
    months = F.broadcast(spine.select(F.col("eval_date").alias("_on_spine")).distinct())
    marked = monthly.join(months, F.col("eval_date") == F.col("_on_spine"), "left")
    entry = F.when(F.col("_on_spine").isNotNull(), F.struct("_on_spine", F.struct(*values)))
    return marked.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def unpack_flow(grid: DataFrame, key: str, values: Sequence[str], name: str) -> DataFrame:
    """Month value and running total ``<value>_cum`` out of the map column ``name`` on a key-by-month grid."""
    grid = grid.withColumn("_at", F.try_element_at(name, "eval_date"))
    grid = grid.select("*", *[nz(F.col("_at")[v]).alias(v) for v in values]).drop("_at")
    return running_total(grid, key, "eval_date", {v: f"{v}_cum" for v in values})


def running_total(df: DataFrame, keys: Sequence[str] | str, order: str, columns: Mapping[str, str]) -> DataFrame:
    """Running sum per key; meant for one row per key and period."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(window).alias(n) for c, n in columns.items()])


def change(current: Column, previous: Column) -> Column:
    """Difference to the previous value; without a difference the current value itself."""
    return F.coalesce(current - previous, current)


def increments(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    columns: Mapping[str, str],
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per-period change of cumulative columns, ``columns = {column: name of its change}``.

    One sort serves every column.  The first period keeps its value, so does one whose previous value is
    NULL; a NULL current value gives NULL.  For one row per key and period.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    window = Window.partitionBy(*keys).orderBy(*order)
    types = types or {}

    def typed(c: str) -> Column:
        value = change(F.col(c), F.lag(c).over(window))
        return value.cast(types[c]) if c in types else value

    return df.select("*", *[typed(c).alias(n) for c, n in columns.items()])


def increments_of_rows(
    df: DataFrame,
    key: str,
    order: str,
    tie_break: Sequence[str],
    columns: Mapping[str, str],
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """``increments`` where a key may have any number of rows per period, ordered by ``tie_break``.

    Rows lie in ranges of (key, period, ties), and only the last row of a range travels on to the next one (see
    ``operators.ranges``), so neither a key nor a period of it is held by one task.  The ranges are a written table: the rows
    are computed and written when this is called.  ``tie_break`` should order the rows of a period fully.
    """
    types = types or {}

    def typed(c: str, value: Column) -> Column:
        return value.cast(types[c]) if c in types else value

    rows = previous_values(df, key, [order, *tie_break], list(columns))
    changes = [typed(c, change(F.col(c), F.col("_prior")[c])).alias(n) for c, n in columns.items()]
    return rows.select(*df.columns, *changes)


def earned_exposure(eff: str, exp: str, evaluated: str, dtype: str = "decimal(10,6)") -> Column:
    """Share of a year earned from inception to the evaluation, at most the term; negative before inception."""
    earned, term = days_between(eff, evaluated), days_between(eff, exp)
    return F.when(earned > term, fraction_of(term, dtype)).otherwise(fraction_of(earned, dtype))


def written_exposure(eff: str, exp: str, dtype: str = "decimal(10,6)") -> Column:
    return fraction_of(days_between(eff, exp), dtype)
