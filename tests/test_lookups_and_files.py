"""Lookups cut to wanted keys, strict documents in the marts, files of bounded size."""

from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.compare import compare
from checks.views import CONFIG, load_book
from harborbook.operators.lookups import likely_wanted, slots_of
from harborbook.plans.attributes import bound_documents
from harborbook.sources import write_mart

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    return load_book(spark, SF)


def test_no_wanted_row_is_lost(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("bucket"))
    wanted = spark.range(0, 40_000, 7).select(F.col("id").cast("string").alias("w"))
    for slots in (1 << 26, 1 << 15, 40, 1):
        got = likely_wanted(rows, ["k"], wanted, slots)
        assert got.columns == ["k", "bucket"]
        assert got.where("bucket % 7 = 0").count() == 2858 and got.where("bucket % 7 = 0").distinct().count() == 2858
        others = got.where("bucket % 7 <> 0").count()
        assert others < 20 if slots == 1 << 26 else others > 0
        assert slots_of(wanted, slots).agg(F.max(F.length("bits"))).first()[0] == 4096
    assert slots_of(wanted, 1 << 16).count() <= 3


def test_wanted_keys_of_several_columns_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), ("b", None)], "x string, y int")
    wanted = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None)], "p string, q int")
    assert [tuple(r) for r in likely_wanted(rows, ["x", "y"], wanted).collect()] == [("a", 1), ("a", 1)]
    assert likely_wanted(rows, ["x", "y"], wanted.limit(0)).count() == 0
    with pytest.raises(ValueError, match="types of x"):
        likely_wanted(rows, ["x"], wanted.select("q"))


def test_documents_are_cut_before_they_are_sorted(spark, book):
    documents = bound_documents(book, CONFIG, quote=["quote_package_data"], rating=["calculation"])
    plan = documents._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, x in enumerate(plan) if "Window [row_number" in x]
    cuts = [i for i, x in enumerate(plan) if "Join Inner" in x and "_bucket" in x]
    assert len(windows) == 3 and len(cuts) >= 2
    # Quotes and ratings: below each window, deeper in the tree, stands a cut.
    for name in ("quote_id", "job_id"):
        window = next(i for i in windows if f"[{name}#" in plan[i])
        assert any(c > window and plan[c].index("Join") > plan[window].index("Window") for c in cuts), name


@pytest.mark.parametrize("name", ["rating_master", "coverage_detail", "rate_change"])
def test_strict_documents_stop_and_tell_the_policy(spark, book, name):
    bad = replace(book, rating=book.rating.withColumn("calculation", F.lit('{"basePremiumCalculation": {"lcm": "2,5"}}')))
    if name == "rating_master":
        bad = replace(bad, rating=bad.rating.withColumn("calculation", F.lit("{bad")))
    with pytest.raises(Exception, match="is no (number|JSON).*policy_id"):
        registry.MARTS[name][0](bad, replace(CONFIG, strict_documents=True)).write.format("noop").mode("overwrite").save()


def test_strict_documents_equal_sql_where_all_are_good(spark, book):
    documents = {c: F.when(F.get_json_object(c, "$").isNotNull(), F.regexp_replace(c, '"n/a"', '""')) for c in ("calculation", "calculation_summary")}
    good = replace(book, rating=book.rating.withColumns(documents))
    build, sql = registry.MARTS["rate_change"]
    report = compare(build(good, replace(CONFIG, strict_documents=True)), sql(), SF)
    assert report["ok"], {k: v for k, v in report.items() if k != "sample"}


def test_files_are_bounded_and_follow_each_other(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id", "if(id % 10 < 6, 'big', concat('p', id % 3)) AS part", "if(id % 3 = 0, 5, id % 1000) AS key")
    out = str(tmp_path / "files")
    write_mart(rows, out, ["part"], ["key"], rows_per_file=400)
    by_part: dict = {}
    for f in sorted((tmp_path / "files").rglob("*.parquet")):
        key = pq.ParquetFile(f).read(columns=["key"])["key"].to_pylist()
        assert key == sorted(key) and 0 < len(key) <= 400
        by_part.setdefault(f.parent.name, []).append((key[0], key[-1], len(key)))
    assert set(by_part) == {"part=big", "part=p0", "part=p1", "part=p2"}
    assert sum(map(len, by_part.values())) <= 2 * 25 + 4 + 1
    assert sum(n for files in by_part.values() for *_, n in files) == 10_000
    for files in by_part.values():
        files.sort()
        assert all(a[1] <= b[0] for a, b in zip(files, files[1:]))
    assert spark.read.parquet(out).select(rows.columns).exceptAll(rows).count() == 0
    write_mart(rows.limit(0), str(tmp_path / "none"), ["part"], ["key"], rows_per_file=400)
    with pytest.raises(ValueError, match="1 or more"):
        write_mart(rows, out, rows_per_file=0)
