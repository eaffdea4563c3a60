"""The marts against plain SQL, and the spread plans against the ordinary ones."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.compare import compare
from checks.views import CONFIG, load_book
from harborbook.plans.catalogue import COVERAGE_FIELDS, RATE_CHANGE_FIELDS, RATING_MASTER_FIELDS
from harborbook.sources import TABLES, conform, from_catalog, schema_of, write_mart

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    return load_book(spark, SF)


def test_catalogue_sizes():
    assert (len(RATING_MASTER_FIELDS), len(COVERAGE_FIELDS), len(RATE_CHANGE_FIELDS)) == (104, 31, 5)
    assert set(registry.all_sql()) == set(registry.all_queries())


@pytest.mark.parametrize("name", list(registry.all_queries()))
def test_query_equals_sql(spark, name):
    report = compare(registry.all_queries()[name](spark, SF), registry.all_sql()[name], SF)
    assert report["ok"], {k: v for k, v in report.items() if k != "sample"}
    assert not report["types"]
    assert report["rows"][0] > 0


@pytest.mark.parametrize("name", list(registry.MARTS))
def test_spread_plan_equals_sql(spark, book, name):
    """Nearly every claim, exposure, policy and business counts as hot."""
    build, sql = registry.MARTS[name]
    report = compare(build(book, replace(CONFIG, hot_parts=100_000)), sql(), SF)
    assert report["ok"], {k: v for k, v in report.items() if k != "sample"}


def test_no_python_and_no_cartesian_product(spark, book):
    for name, (build, _) in registry.MARTS.items():
        plan = build(book, CONFIG)._jdf.queryExecution().executedPlan().toString()
        for node in ("Python", "Pandas", "CartesianProduct"):
            assert node not in plan, (name, node)


def test_only_needed_columns_are_read(spark, book):
    plan = registry.MARTS["rate_change"][0](book, CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert "quote_package_data" not in plan
    assert "claims_ledger" not in plan


def test_increments_add_up(spark, book):
    """Per exposure the paid changes add up to the last cumulative amount."""
    claims = registry.MARTS["claim_development"][0](book, CONFIG)
    single = claims.groupBy("exposure_id").agg(
        F.sum("paid_inc").alias("changes"),
        F.max_by("paid", "eval_date").alias("last"),
        F.countDistinct("eval_date").alias("months"),
        F.count("*").alias("n"),
    ).where("months = n")
    assert single.count() > 0
    assert single.where("changes <> last").count() == 0


def test_fractions_add_up_to_one_claim(spark, book):
    claims = registry.MARTS["claim_development"][0](book, CONFIG)
    per_claim = claims.groupBy("claim_id", "eval_date").agg(F.sum("count_claim").alias("s"), F.count("*").alias("n"))
    assert per_claim.where("abs(s - 1) > n * 0.000001").count() == 0


def test_catalog_source_and_sink(spark, book, tmp_path):
    for t in TABLES:
        getattr(book, t).createOrReplaceTempView(f"in_{t}")
    again = from_catalog(spark, {t: f"in_{t}" for t in TABLES})
    out = str(tmp_path / "rates")
    write_mart(registry.MARTS["rate_change"][0](again, CONFIG), out, sort_by=["policy_reference"])
    assert spark.read.parquet(out).count() == registry.MARTS["rate_change"][0](book, CONFIG).count()
    with pytest.raises(ValueError, match="no table named"):
        from_catalog(spark, {"periods": "in_periods"})
    with pytest.raises(ValueError, match="missing columns date"):
        conform(book.periods.drop("date"), "periods")
    assert schema_of("scores").fieldNames() == ["business_id", "score", "creation_time"]


def test_options_of_the_policy_marts(spark, book):
    build = registry.MARTS["policy_monitoring"][0]
    strict = dict(build(book, replace(CONFIG, strict_types=True)).dtypes)
    assert strict["ep_inc"] == strict["wp_inc"] == "decimal(10,6)"
    ordered = build(book, CONFIG, ordered=True)
    assert dict(ordered.dtypes)["ep_inc"] == "decimal(18,6)" and len(ordered.columns) == 132
    keys = [tuple(r) for r in ordered.select("policy_reference", "eval_date").collect()]
    assert keys == sorted(keys, key=lambda k: (k[0] is not None, k[0] or "", k[1]))


def test_config_dates():
    assert CONFIG.through.isoformat() == "2001-06-30"
    with pytest.raises(ValueError, match="carrier"):
        replace(CONFIG, carriers=())
