"""Whole-group totals and joins that keep working when one key holds a large share of the rows.

A shuffled join or window sends all rows of a key to one task.  Here every key gets a fan-out of its own: rows are counted
per hash of the key columns, pre-aggregated on the map side, and a key with more rows than an average part (all rows /
``parts``) is dealt over as many sub-keys as it would fill parts.  The other side of a join is repeated once per sub-key of
its key, all other keys stay whole.  Totals are pre-aggregated and joined back.

The counts stay a DataFrame: nothing is collected, no job runs while a plan is built unless they are ``settled``, and the plan
is the same at every size.  Fewer than ``parts`` keys can be larger than an average part, which bounds the side that is broadcast, and their
sub-keys are fewer than ``2 * parts``.  Counts only steer the work; both sides decide by the same hash, so results do not
depend on them.  The salt is a hash of the row, so a task that is run again after a lost executor sends each row to the same
place; fold exact copies first where a key may have very many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborbook.operators.lineage import settle


@dataclass(frozen=True)
class Hot:
    """``fans`` holds (_hash, _fan), the hash of a hot value of some key columns and its number of sub-keys."""

    fans: DataFrame

    def settled(self) -> Hot:
        """The same from a written table of fewer than ``parts`` rows, for plans that use it many times."""
        return Hot(settle(self.fans, "hot"))

    def salted(self, df: DataFrame, keys: Sequence[str], salt: Column, name: str) -> DataFrame:
        """``df`` with column ``name``: ``salt``, which may use ``_fan``, the fan-out of the row's key (1 if not hot)."""
        fans = F.broadcast(self.fans)  # fewer than ``parts`` rows
        marked = df.withColumn("_hash", F.xxhash64(*keys)).join(fans, "_hash", "left")
        return marked.withColumn("_fan", F.coalesce("_fan", F.lit(1))).withColumn(name, salt).drop("_hash", "_fan")


def find_hot_keys(df: DataFrame, keys: Mapping[str, Sequence[str]], parts: int | None = None) -> dict[str, Hot]:
    """Fan-outs for several keys from one pass over their columns; NULL is a value like any other.

    ``parts`` is the number of shuffle partitions unless given.
    """
    large = _large_keys(df, keys, parts)
    return {name: Hot(large.where(F.col("kind") == name).select("_hash", "_fan")) for name in keys}


def settled_hot_keys(df: DataFrame, keys: Mapping[str, Sequence[str]], parts: int | None = None) -> dict[str, Hot]:
    """``find_hot_keys`` counted now, once for all keys, and written as one table."""
    large = settle(_large_keys(df, keys, parts), "hot")
    return {name: Hot(large.where(F.col("kind") == name).select("_hash", "_fan")) for name in keys}


def _large_keys(df: DataFrame, keys: Mapping[str, Sequence[str]], parts: int | None) -> DataFrame:
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [F.struct(F.lit(name).alias("kind"), F.xxhash64(*columns).alias("_hash")) for name, columns in keys.items()]
    counts = df.select(F.inline(F.array(*kinds))).groupBy("kind", "_hash").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.sum("n") / F.lit(len(kinds) * parts)).scalar()
    return counts.where(F.col("n") > mean).select("kind", "_hash", F.ceil(F.col("n") / mean).cast("int").alias("_fan"))


def fold_copies(df: DataFrame, count_col: str = "copies") -> DataFrame:
    """Exact copies of a row as one row with their number; they meet on the map side."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count_col))


def hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can be taken of."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    *,
    hot: Hot | None = None,
    hot_on: Sequence[str] | None = None,
    null_safe: bool = False,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` left or inner with the large keys of ``left`` spread.

    ``hot`` speaks about the columns ``hot_on`` (default: ``on``); without it the rows of ``left`` are counted, which reads
    their keys once more.  ``null_safe`` lets NULL match NULL.  ``spread`` names columns that tell the rows of a key apart
    well enough to deal them out (default: all); a step that needs few columns then moves only these.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner"):
        raise ValueError(f"salted_join supports left and inner joins, not {how!r}")
    hot_on = list(hot_on or keys)
    hot = hot or find_hot_keys(left, {"key": hot_on})["key"]
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    hashed = spread or hashable(left)
    left = hot.salted(left, hot_on, F.pmod(F.xxhash64(*hashed), F.col("_fan")), "_salt")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_fan").cast("bigint") - 1))
    other = hot.salted(other, [f"_r_{k}" for k in hot_on], copies, "_r_salt")
    pairs = [(F.col(k), F.col(f"_r_{k}")) for k in keys]
    match = reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs], F.col("_salt") == F.col("_r_salt"))
    return left.join(other, match, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def attach_totals(
    detail: DataFrame,
    on: Sequence[str] | str,
    totals: Mapping[str, Column],
    hot: Hot | None = None,
    hot_on: Sequence[str] | None = None,
    *,
    of: DataFrame | None = None,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregates over all rows of a group next to every row; NULL keys are a group of their own.

    ``of`` names rows with the same groups that are cheaper to add up than ``detail``, such as those it was made from.
    ``spread`` is as for ``salted_join``.
    """
    keys = [on] if isinstance(on, str) else list(on)
    per_group = (detail if of is None else of).groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return salted_join(detail, per_group, keys, "left", hot=hot, hot_on=hot_on, null_safe=True, spread=spread)
