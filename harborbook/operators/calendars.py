"""Month spine of an evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborbook.functions import yyyymm


def month_spine(periods: DataFrame, start: date, through: date) -> DataFrame:
    """``(eval_date, eval_date_full)`` for the months of the calendar days between ``start`` and ``through``.

    One row per month, so its size is bounded by the length of the evaluation and it may be broadcast.
    """
    days = periods.where((F.col("date") <= F.lit(through)) & (F.col("date") >= F.lit(start)))
    return days.select(
        yyyymm("monthlastday").alias("eval_date"), F.col("monthlastday").cast("date").alias("eval_date_full")
    ).distinct()


def generated_spine(spark: SparkSession, start: date, through: date) -> DataFrame:
    """The same spine without a calendar table."""
    months = F.sequence(F.trunc(F.lit(start), "month"), F.trunc(F.lit(through), "month"), F.expr("interval 1 month"))
    ends = spark.range(1).select(F.explode(months).alias("_first")).select(F.last_day("_first").alias("eval_date_full"))
    return ends.select(yyyymm("eval_date_full").alias("eval_date"), "eval_date_full")


def at_month_ends(df: DataFrame, spine: DataFrame, column: str = "date") -> DataFrame:
    """Rows dated on a month end of the spine.

    The spine is broadcast: with storage partitioned by ``column`` only the month-end partitions are read.
    """
    ends = F.broadcast(spine.select(F.col("eval_date_full").alias("_month_end")).distinct())
    return df.join(ends, F.col(column) == F.col("_month_end"), "left_semi")


def up_to_last_month(df: DataFrame, spine: DataFrame, column: str = "date") -> DataFrame:
    """Rows dated up to the last month end of the spine (a one-row sub-query, pushed to the scan)."""
    return df.where(F.col(column) <= spine.select(F.max("eval_date_full")).scalar())
