"""Fingerprints of documents: the ``SIZE`` smallest hashes of their word shingles, in ascending order.

A sketch is an ``array<bigint>``.  Sketches of parts merge to the sketch of the whole, and two of them estimate the
resemblance, containment and number of distinct shingles of what they were taken from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.texts import bound, shingle_hashes, word_array

SIZE, WORDS = 256, 5

#: Rows of an order that one task handles together, and steps of equal numbers of ids it is cut into at most.
BLOCK, CUTS = 4_000, 1_024


def sketch(text: Column, size: int = SIZE, words: int = WORDS) -> Column:
    """Of the whole text; empty for a text without words."""
    return F.slice(F.sort_array(shingle_hashes(word_array(text), words)), 1, size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_sketches(parts: DataFrame, key: str, column: str, size: int = SIZE) -> DataFrame:
    """One sketch per key of any number of partial ones.  A key sends ``size`` hashes per task at most."""
    rows = parts.select(key, F.explode(column).alias("_hash"))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("_hash"))
    least = rows.withColumn("_rank", rank).where(F.col("_rank") <= size).groupBy(key).agg(F.sort_array(F.collect_set("_hash")).alias(column))
    keys = parts.select(key).distinct()
    return keys.join(least.withColumnRenamed(key, "_key"), keys[key].eqNullSafe(F.col("_key")), "left").select(
        key, F.coalesce(column, F.array().cast("array<bigint>")).alias(column)
    )


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity, exact as long as all hashes fit; 1 for two empty sketches."""

    def share(union: Column) -> Column:
        shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))

    return bound(merged(a, b, size), share)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles, exact below ``size``."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / last)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, 1 if ``a`` has none."""
    j, na, nb = resemblance(a, b, size), distinct_shingles(a, size), distinct_shingles(b, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(a: Column) -> Column:
    """Sixteen hex digits for every hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(rows: DataFrame, order: str, ties: str, columns: list[str], into: str, behind: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with a struct of ``columns`` of the next row in descending order, of the first after the last.

    The order is cut at quantiles of ``order``, and these blocks, with the first row of the following block behind each,
    are laid out over the tasks in one shuffle.  ``order`` is an integer; nulls come last, equal values are ordered by
    ``ties``.  The columns ``behind`` are computed behind this shuffle, so they are not moved; ``columns`` may name them.
    """
    behind = behind or {}
    at = F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63)))
    count = rows.count()
    if not count:
        rows = rows.withColumns(behind)
        kinds = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in columns)
        return rows.withColumn(into, F.lit(None).cast(f"struct<{kinds}>".replace(": ", ":")))
    cells = max(1, min(CUTS, -(-count // BLOCK)))
    shares = [k / cells for k in range(1, cells)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx(at, shares, 10 * CUTS).alias("c")).first()["c"]))
    cell = F.size(F.filter(F.lit(cuts), lambda c: c < at))
    # Within a cell ids are cut into equal steps where a cell holds far more rows than a block.
    inner = -(-count // (BLOCK * cells))
    low = F.coalesce(F.get(F.lit(cuts), cell - 1), F.lit(cuts[0])).cast("double")
    high = F.coalesce(F.get(F.lit(cuts), cell), F.lit(cuts[-1])).cast("double")
    step = F.when(high > low, F.floor((at - low) / (high - low) * inner)).otherwise(0)
    block = (cell.cast("bigint") * inner + F.greatest(F.lit(0), F.least(step, F.lit(inner - 1)))) if inner > 1 else cell.cast("bigint")

    numbered = rows.select("*", at.alias("_at"), block.alias("_block"))
    firsts = numbered.groupBy("_block").agg(F.max("_at").alias("_first"))
    around = Window.orderBy(F.desc("_block"))  # as many rows as blocks
    before = F.coalesce(F.lag("_block").over(around), F.min("_block").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select("_first", before.alias("_before"))
    if cells * inner <= 100_000:
        firsts = F.broadcast(firsts)
    spread = numbered.join(firsts, F.col("_at") == F.col("_first"), "left")
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("block"), F.lit(True).alias("copy"))
    spread = spread.withColumn("_place", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    # The block by a column of its own: dealt out by it, the rows lie as the window wants them.
    spread = spread.select(*rows.columns, "_at", F.col("_place")["block"].alias("_to"), F.col("_place")["copy"].alias("_copy"))
    spread = spread.repartition("_to").withColumns(behind)
    window = Window.partitionBy("_to").orderBy("_copy", F.desc("_at"), ties)
    out = spread.withColumn(into, F.lead(F.struct(*columns)).over(window)).where(~F.col("_copy"))
    return out.select(*rows.columns, *behind, into)
