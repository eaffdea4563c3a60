"""What is moved and how often it is planned: steps over the ledger carry what they need, and long plans do not multiply."""

import re

import pytest
from pyspark.sql import functions as F

from checks.operator_queries import QUERIES
from checks.views import load_book
from harborbook.operators.losses import fractional_counts, open_closed_status
from harborbook.operators.skew import find_hot_keys

SF = "/root/testdata/sf0.001"


def moved(df):
    """The columns that each exchange of a plan takes in."""
    said = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\n(?:Input|Output) \[\d+\]: \[(.*?)\]", said)


def test_status_moves_no_column_it_does_not_need(spark):
    rows = spark.range(200).selectExpr(
        "concat('c', id % 20) AS claim_id", "concat('e', id % 50) AS exposure_id", "id % 3 AS month",
        "CAST(id % 7 - 3 AS DECIMAL(18,2)) AS reserve", "1 AS copies", "repeat('x', 100) AS note_of_claim",
    )
    status = open_closed_status(rows, "month", ["reserve"])
    assert "note_of_claim" in status.columns and "_spread" not in status.columns
    short = status.select("claim_id", "exposure_id", "month", "claim_status", "exposure_status")
    assert len(moved(short)) >= 4 and not [x for x in moved(short) if "note_of_claim" in x]
    assert short.count() == 200


def test_counts_do_not_multiply_the_plan(spark):
    """With hot keys left to ``fractional_counts`` they are counted in its input, not in what it made of it."""
    claims = spark.range(60).selectExpr(
        "concat('c', id % 9) AS claim_id", "concat('e', id) AS exposure_id", "1 AS eval_date", "id AS paid", "id AS claim_lvl_eval_paid",
        "'closed' AS claim_status", "'closed' AS exposure_status", "'non-CAT' AS cat_ind",
    )
    out = fractional_counts(claims)
    assert out.agg(F.sum("count_claim")).first()[0].to_integral_value() == 9
    assert out._jdf.queryExecution().analyzed().toString().count("Range (") <= 24


def test_hot_keys_of_a_mart_are_a_written_table(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k")
    settled = find_hot_keys(rows, {"k": ["k"]}, 12)["k"].settled()
    assert "Range" not in settled.fans._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["_fan"] for r in settled.fans.collect()) == [4, 4, 5]


def test_fractional_claim_counts_reads_the_ledger_a_few_times(spark):
    df = QUERIES["fractional_claim_counts"][0](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 120


def test_problems_are_listed_with_one_parse_per_document(spark):
    """Also below the list of problems no step parses the documents again."""
    plan = QUERIES["problems_of_nested_documents"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # the document and its sub-document
    assert plan.count("get_json_object(") == 2


def shuffled(df):
    """Bytes that the shuffles of a query write; the query is run."""
    df.collect()
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif kind != "ReusedExchangeExec":
            metrics = node.metrics()
            if metrics.contains("shuffleBytesWritten"):
                total += metrics.apply("shuffleBytesWritten").value()
            nodes.extend(node.children().apply(k) for k in range(node.children().size()))
    return total


@pytest.mark.parametrize("name", ["claims_rolled_up", "losses_by_coverage_and_cause", "policy_losses_by_month"])
def test_rows_of_a_claim_are_moved_once(spark, name):
    """Statuses come to the rows, and what follows is done where they lie; the rows of a ledger move two to three times at most."""
    ledger = load_book(spark, SF).claims_ledger
    once = shuffled(ledger.repartition(4, "claim_id"))
    assert 0 < shuffled(QUERIES[name][0](spark, SF)) < 4 * once


def test_rows_of_claim_development_move_to_claims_and_exposures(spark):
    ledger = load_book(spark, SF).claims_ledger
    once = shuffled(ledger.repartition(4, "claim_id"))
    assert 0 < shuffled(QUERIES["fractional_claim_counts"][0](spark, SF)) < 8 * once
