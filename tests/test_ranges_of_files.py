"""Ranges that files are written from."""

from harborbook.sources.sinks import _ranges, write_mart


def test_ranges_follow_tasks_and_not_files(spark, tmp_path):
    """Half a million files are not half a million ranges, whose bounds the driver would find from a sample of each."""
    assert _ranges(54_000_000, 100, 200) == 200
    assert _ranges(900_000_000, 100, 200) == 900
    assert [_ranges(n, 100, 200) for n in (0, 1, 100, 101, 19_999)] == [1, 1, 1, 2, 200]
    write_mart(spark.range(2000), str(tmp_path / "files"), sort_by=["id"], rows_per_file=10)
    tasks = {f.name[5:10] for f in (tmp_path / "files").glob("*.parquet")}
    assert len(tasks) <= 4
    rows = spark.read.parquet(str(tmp_path / "files"))
    assert rows.count() == 2000 and max(r["count"] for r in rows.groupBy("_metadata.file_path").count().collect()) <= 10
