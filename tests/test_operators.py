from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from harborbook.config import NON_CAT_CODES_CLAIMS, NON_CAT_CODES_POLICY, NON_CAT_FRAGMENTS_CLAIMS
from harborbook.operators.calendars import at_month_ends, generated_spine, month_spine
from harborbook.operators.crime import crime_scores
from harborbook.operators.enrich import latest_scores
from harborbook.operators.flows import earned_exposure, increments, monthly_flow, written_exposure
from harborbook.operators.keys import keep_singletons, latest_per_key, top_rank_per_key
from harborbook.operators.losses import (
    cat_flag,
    coverage_flags,
    lifetime_losses,
    open_closed_status,
    peril_flags,
    prior_loss_flag,
    tpa_id_trim,
)
from harborbook.operators.rating import (
    base_premium_fallback,
    policy_term,
    prior_term_classes,
    prior_term_pairs,
    rate_premium,
    state_switch_premium,
    tria_indicator,
)
from harborbook.sources import schema_of


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def ledger(spark, items):
    """Ledger rows from dictionaries; what is left out is NULL, or 0 for amounts."""
    schema = schema_of("claims_ledger")
    amounts = [f.name for f in schema if f.name.endswith("_total")]
    base = {f.name: None for f in schema} | {a: D("0.00") for a in amounts} | {"lob": "IM"}
    return spark.createDataFrame([tuple((base | i)[f.name] for f in schema) for i in items], schema)


def test_month_spine(spark):
    days = [(date(2024, 1, 30), date(2024, 1, 31)), (date(2024, 1, 31), date(2024, 1, 31)), (date(2024, 2, 29), date(2024, 2, 29)),
            (date(2024, 3, 1), date(2024, 3, 31))]
    periods = spark.createDataFrame(days, "date date, monthlastday date")
    spine = month_spine(periods, date(2024, 1, 31), date(2024, 2, 29))
    want = [(202401, date(2024, 1, 31)), (202402, date(2024, 2, 29))]
    assert rows(spine, "eval_date") == want
    assert rows(generated_spine(spark, date(2024, 1, 31), date(2024, 2, 29)), "eval_date") == want
    dated = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 1, 30),)], "date date")
    assert rows(at_month_ends(dated, spine), "date") == [(date(2024, 1, 31),)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 2, 9), ("a", 2, 8), ("a", 1, 1), ("b", None, 5), ("b", 3, 4), (None, 1, 1)], "k string, t int, v int")
    assert rows(latest_per_key(df, "k", "t", ["v"]), "v") == [(None, 1, 1), ("b", 3, 4), ("a", 2, 8)]
    assert ("b", None, 5) in rows(latest_per_key(df, "k", "t", ["v"], nulls="first"), "v")


def test_top_rank_keeps_ties(spark):
    df = spark.createDataFrame([("a", 2, 9), ("a", 2, 8), ("a", 1, 1)], "k string, t int, v int")
    assert rows(top_rank_per_key(df, "k", "t"), "v") == [("a", 2, 8), ("a", 2, 9)]
    scores = [("b", 600, datetime(2024, 1, 2)), ("b", 650, datetime(2024, 1, 2)), ("b", None, datetime(2024, 1, 3))]
    scores = spark.createDataFrame(scores, "business_id string, score int, creation_time timestamp")
    assert rows(latest_scores(scores), "credit_score") == [("b", 600), ("b", 650)]


def test_keep_singletons(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3), ("c", None), (None, 7)], "k string, v int")
    assert rows(keep_singletons(df, "k"), "k") == [("b", 3), ("c", None)]


def test_top_one_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    plan = latest_per_key(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_monthly_flow(spark):
    spine = generated_spine(spark, date(2024, 1, 1), date(2024, 3, 31))
    tx = [("p", date(2023, 12, 5), D("100")), ("p", date(2024, 1, 5), D("10")), ("p", date(2024, 1, 9), None), ("p", date(2024, 3, 1), D("5")),
          ("q", date(2023, 11, 1), D("7")), (None, date(2024, 1, 1), D("3"))]
    tx = spark.createDataFrame(tx, "k string, d date, amount decimal(18,2)")
    flow = monthly_flow(tx, "k", "d", {"x": F.col("amount")}, spine).select("k", "eval_date", "x", "x_cum")
    assert rows(flow, "k", "eval_date") == [
        ("p", 202401, 10, 10), ("p", 202402, 0, 10), ("p", 202403, 5, 15),
        ("q", 202401, 0, 0), ("q", 202402, 0, 0), ("q", 202403, 0, 0),
    ]
    plan = monthly_flow(tx, "k", "d", {"x": F.col("amount")}, spine)
    physical = plan._jdf.queryExecution().executedPlan().toString()
    before_window = physical[: physical.index("BroadcastNestedLoopJoin")]
    assert "Exchange" not in before_window  # the key-by-month grid is not shuffled


def test_increments(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 8), ("a", 3, None), ("a", 4, 9)], "k string, t int, v int")
    assert [r[3] for r in rows(increments(df, "k", "t", {"v": "inc"}), "t")] == [5, 3, None, 9]


def test_exposure(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), date(2025, 1, 1), date(2026, 1, 1)), (date(2024, 1, 1), date(2025, 1, 1), date(2023, 12, 31))],
        "e date, x date, v date",
    )
    got = rows(df.select(earned_exposure("e", "x", "v").alias("ee"), written_exposure("e", "x").alias("we")), F.desc("ee"))
    assert got == [(D("1.002740"), D("1.002740")), (D("-0.002740"), D("1.002740"))]


def test_cat_flag(spark):
    codes = [None, "", "SIU", "COVID19", "Subro-12", "CAT-55"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    claims = [r[1] for r in rows(df.select("i", cat_flag("c", NON_CAT_CODES_CLAIMS, NON_CAT_FRAGMENTS_CLAIMS)), "i")]
    policy = [r[1] for r in rows(df.select("i", cat_flag("c", NON_CAT_CODES_POLICY)), "i")]
    assert claims == ["non-CAT"] * 5 + ["CAT"]
    assert policy == ["non-CAT"] * 3 + ["CAT"] * 3


def test_ids_perils_and_coverages(spark):
    df = spark.createDataFrame(
        [(0, "x" * 16, "T", "EQUIPMENT_BREAKDOWN_X", "EMPLOYEE_TOOlS_AND_CLOTHING", "TX"),
         (1, "x" * 16, None, "EQUIPMENTXBREAKDOWN", "EMPLOYEE_TOOLS_AND_CLOTHING", "CA"),
         (2, "y", "T", "FIRE", "BLANKET_EQUIPMENT", None)],
        "i int, id string, tpa string, cause string, cov string, st string",
    )
    flags = [c.alias(n) for n, c in (peril_flags("cause") | coverage_flags("cov", "st")).items()]
    got = rows(df.select("i", tpa_id_trim("id", "tpa", "T", 13), *flags), "i")
    assert got == [(0, "x" * 13, 0, 0, 1, 0, 1, 0), (1, "x" * 16, 0, 0, 1, 0, 0, 1), (2, "y", 1, 0, 0, 0, 0, 0)]


def test_open_closed(spark):
    items = [
        {"claim_id": "z", "exposure_id": "1", "date": date(2024, 1, 31), "loss_reserve_total": D("5")},
        {"claim_id": "z", "exposure_id": "2", "date": date(2024, 1, 31), "loss_reserve_total": D("-5")},
        {"claim_id": "o", "exposure_id": "3", "date": date(2024, 1, 31), "loss_reserve_total": None, "expense_ao_reserve_total": D("1")},
    ]
    df = ledger(spark, items).withColumn("copies", F.lit(1))
    got = open_closed_status(df, "date", ("loss_reserve_total", "expense_ao_reserve_total"))
    assert rows(got.select("exposure_id", "claim_status", "exposure_status"), "exposure_id") == [
        ("1", "closed", "Open"), ("2", "closed", "closed"), ("3", "Open", "Open"),
    ]


def test_lifetime_views(spark):
    day1, day2 = date(2024, 1, 31), date(2024, 2, 29)
    items = [
        {"policy_reference": "p", "claim_id": "c", "exposure_id": "1", "date": day1, "loss_paid_total": D("9")},
        {"policy_reference": "p", "claim_id": "c", "exposure_id": "1", "date": day2, "loss_paid_total": D("4"), "loss_reserve_total": D("2")},
        {"policy_reference": "p", "claim_id": "c", "exposure_id": "2", "date": day2, "loss_paid_total": D("50")},
        {"policy_reference": "q", "claim_id": "d", "exposure_id": "3", "date": day1, "loss_paid_total": None},
        {"policy_reference": "p", "claim_id": "e", "exposure_id": "4", "date": day1, "loss_paid_total": D("1"), "lob": "GL"},
    ]
    # One exposure stands for its claim, so the 50 of the second exposure is not seen.
    assert rows(lifetime_losses(ledger(spark, items), "IM"), "policy_reference") == [("p", 6, 4, 1, 1), ("q", 0, 0, 1, 0)]
    policies = spark.createDataFrame([("1", "p", "b"), ("2", "p", "b"), ("3", "q", "b")], "policy_id string, policy_reference string, business_id string")
    assert rows(prior_loss_flag(ledger(spark, items), policies, "IM"), "policy_reference") == [("b", "p", "Y"), ("b", "q", "N")]


def test_crime_scores(spark):
    doc = '{"Address": {"StreetAddress1": "Main ST", "Zip": "501"}, "Ms3": {"Crime": {"Burglary": {"IndexValuesUpto10": {"Current": "4"}}}}}'
    day = datetime(2024, 1, 1)
    a = [("Verisk", doc, day), ("Verisk", doc, day), ("Verisk", "{bad", day), ("Other", doc, day), ("Verisk", None, day)]
    a = spark.createDataFrame(a, "provider string, response_data string, creation_time timestamp")
    b = spark.createDataFrame([("{}", "MAIN st", "00501", datetime(2023, 1, 1)), ("", "x", "1", day)],
                              "verisk_json_response string, street string, zip_code string, creation_time timestamp")
    got = rows(crime_scores(a, b, "Verisk").drop("creation_time"), "street")
    assert got == [(None, 4, None, None, "main st", "00501")]


def test_rate_premium_tiers(spark):
    df = spark.createDataFrame([(5000,), (10000,), (15000,), (None,)], "v int").select(F.col("v").cast("decimal(18,0)").alias("v"))

    def rate(x):
        return F.lit(x).cast("decimal(4,2)")

    cols = rate_premium("v", rate("2.67"), rate("1.84"), rate("1"), rate("2"), rate("1.5"))
    got = {r["v"]: (r["pure"], r["mod"]) for r in df.select("v", cols["pure_premium"].alias("pure"), cols["modified_premium"].alias("mod")).collect()}
    assert got[5000] == (D("133.5"), D("400.5")) and got[10000][0] == 267 and got[15000][0] == 359 and got[None][0] == 267


def test_terms_and_pairs(spark):
    start = date(2024, 1, 1)
    df = spark.createDataFrame([(date(2024, 12, 30),), (date(2024, 12, 31),), (date(2025, 12, 31),)], "d date")
    assert [r[0] for r in df.select(policy_term(F.lit(start), "d")).collect()] == [0, 1, 2]
    policies = [("b", 0, date(2024, 1, 1), "w"), ("b", 0, date(2024, 5, 1), "x"), ("b", 0, date(2024, 5, 1), "y"),
                ("b", 1, date(2025, 1, 1), "z"), ("g", 0, date(2024, 1, 1), "m"), ("g", 2, date(2026, 1, 1), "n")]
    policies = spark.createDataFrame(policies, "business_id string, policy_term int, eff_date date, id string")
    pairs = prior_term_pairs(policies, {"id": "before"}, ["business_id", "policy_term", "id"])
    got = rows(pairs.select("id", "before"), "id", "before")
    assert got == [("m", None), ("n", None), ("w", None), ("x", None), ("y", None), ("z", "x"), ("z", "y")]


def test_term_classes_equal_pairs(spark):
    policies = [("b", 0, date(2024, 1, 1), 1, 10), ("b", 0, date(2024, 5, 1), 2, 20), ("b", 0, date(2024, 5, 1), 3, None),
                ("b", 1, date(2025, 1, 1), 4, 5), ("b", 1, date(2025, 2, 1), 5, 6), ("b", 1, date(2025, 2, 1), 5, 6),
                ("g", 2, date(2026, 1, 1), 6, None), (None, 0, date(2024, 1, 1), 7, 1), (None, 1, date(2025, 1, 1), 8, 1), ("h", None, date(2024, 1, 1), 9, 2)]
    policies = spark.createDataFrame(policies, "business_id string, policy_term int, eff_date date, id int, amount int")
    carried, keep = {"id": "before", "amount": "was"}, ["business_id", "policy_term", "id", "amount"]
    term = ["business_id", "policy_term"]
    pairs = prior_term_pairs(policies, carried, keep).groupBy(*term)
    pairs = pairs.agg(F.countDistinct("id"), F.countDistinct("before"), F.count("*"), F.sum("amount").cast("int"), F.sum("was").cast("int"))
    classes = prior_term_classes(policies, carried, keep, ["amount", "was"])
    classes = classes.select(*term, "n_policies", "n_earlier", "n_pairs", F.col("amount").cast("int"), F.col("was").cast("int"))
    got = {tuple(r) for r in classes.collect()}
    assert got == {tuple(r) for r in pairs.collect()} and ("b", 1, 2, 2, 4, 22, 40) in got
    assert prior_term_classes(policies.limit(0), carried, keep).count() == 0
    with pytest.raises(ValueError, match="neither kept nor carried: eff_date"):
        prior_term_classes(policies, carried, keep, ["eff_date"])


def test_many_tied_policies_make_no_pairs_inside(spark):
    tied = spark.range(20_000).selectExpr("'b' AS business_id", "int(id % 2) AS policy_term", "DATE '2024-01-01' AS eff_date", "id", "1 AS amount")
    got = prior_term_classes(tied, {"id": "before", "amount": "was"}, ["business_id", "policy_term", "id", "amount"], ["was"])
    assert rows(got.select("policy_term", "n_pairs", F.col("was").cast("long")), "policy_term") == [(0, 10_000, None), (1, 100_000_000, 100_000_000)]


def test_premium_switches(spark):
    df = spark.createDataFrame([(0, "", "12|x", "CA"), (1, "7", "12|x", "TX"), (2, None, None, None)], "i int, f string, c string, st string")
    got = rows(df.select("i", base_premium_fallback("f", "c"), state_switch_premium("st", F.lit(1), F.lit(2)), tria_indicator(F.col("i") - 1)), "i")
    assert got == [(0, 12, 1, "N"), (1, 7, 2, "N"), (2, None, 0, "Y")]
