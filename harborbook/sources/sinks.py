"""Writing a mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.operators.lineage import settle


#: Rows that a task writes at least before there are more tasks than shuffle partitions.
ROWS_PER_TASK = 1_000_000


def _ranges(rows: int, rows_per_file: int, parts: int) -> int:
    """Ranges to deal ``rows`` into: one per file while these are few, else one per task."""
    return max(1, min(-(-rows // rows_per_file), max(parts, -(-rows // ROWS_PER_TASK))))


def write_mart(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), rows_per_file: int | None = None
) -> None:
    """Overwrite ``path`` with the mart as Parquet.

    Rows are ordered inside each file, so readers filter on the sort columns' ranges.  Without ``rows_per_file`` each task
    writes a file per partition it has rows of, and nothing is shuffled.

    With ``rows_per_file`` no file has more rows, and n rows in p partitions make 2 * n / ``rows_per_file`` + p + 1 files
    at most.  The rows are dealt into ranges of (partition, sort columns), so the files of a partition follow each other:
    two of them share the value at which one ends and the next begins at most.  A value or a partition with very many rows is
    dealt to several tasks.  A task writes many files one after the other, so there are as many ranges as tasks are worth
    while, and the sample of rows that the driver finds their bounds by does not grow with the number of files.  The rows
    are counted and sampled, so they are written to the shared folder first.
    """
    keys = [*partition_by, *sort_by]
    out = df
    if rows_per_file is not None:
        if rows_per_file < 1:
            raise ValueError("rows_per_file must be 1 or more")
        rows = settle(df, "mart")
        ranges = _ranges(rows.count(), rows_per_file, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        spread = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])
        out = rows.withColumn("_tie", spread).repartitionByRange(ranges, *keys, "_tie")
    if keys:
        out = out.sortWithinPartitions(*keys)
    writer = out.drop("_tie").write.mode("overwrite") if rows_per_file is not None else out.write.mode("overwrite")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
