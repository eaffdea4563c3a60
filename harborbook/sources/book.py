"""The thirteen inputs of the marts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborbook.sources.schemas import SCHEMAS


@dataclass(frozen=True)
class Book:
    """One DataFrame per logical table; which physical table stands behind it is the caller's choice."""

    periods: DataFrame
    claims_ledger: DataFrame
    snapshots: DataFrame
    policies: DataFrame
    addresses: DataFrame
    rating: DataFrame
    quotes: DataFrame
    submissions: DataFrame
    policy_transactions: DataFrame
    scores: DataFrame
    third_party: DataFrame
    property_risk: DataFrame
    company_metrics: DataFrame


TABLES = tuple(f.name for f in fields(Book))


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of the logical table in their types; other columns are never read."""
    wanted = schema_of(table)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {', '.join(missing)}")
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]
    )


def from_catalog(spark: SparkSession, names: Mapping[str, str]) -> Book:
    """Inputs from catalog tables or temporary views, ``names = {logical table: one- to three-part name}``."""
    unnamed = [t for t in TABLES if t not in names]
    if unnamed:
        raise ValueError(f"no table named for {', '.join(unnamed)}")
    return Book(**{t: conform(spark.table(names[t]), t) for t in TABLES})


def from_parquet(spark: SparkSession, root: str) -> Book:
    """Inputs from ``<root>/<logical table>`` in Parquet."""
    return Book(**{t: conform(spark.read.parquet(f"{root}/{t}"), t) for t in TABLES})


def from_frames(frames: Mapping[str, DataFrame]) -> Book:
    return Book(**{t: conform(frames[t], t) for t in TABLES})
