"""Claim development: one row per claim exposure and month end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.config import NON_CAT_CODES_CLAIMS, NON_CAT_FRAGMENTS_CLAIMS, MartConfig
from harborbook.operators.calendars import month_spine
from harborbook.operators.crime import CRIMES
from harborbook.operators.flows import increments, increments_of_rows
from harborbook.operators.homes import HOME, join_at_home
from harborbook.operators.lineage import settle
from harborbook.operators.losses import (
    RESERVES,
    cat_flag,
    cents,
    fractional_counts,
    loss_measures,
    non_cat,
    paid_amount,
    report_lag,
    total_of,
    with_shares,
)
from harborbook.operators.skew import Hot, attach_totals, salted_join
from harborbook.plans.attributes import policy_attributes
from harborbook.plans.exposures import (
    at_home,
    beside_claims,
    book_ledger,
    claim_identity,
    hot_in_ledger,
    in_homes,
    named,
    open_in_month,
    periods,
    policy_dates,
    policy_ids,
    split_ledger,
    with_statuses,
)
from harborbook.sources import Book

REPORT_LAG_CAP = 50

# Column order of the mart.
EXPOSURE_COLUMNS = (
    "eval_date",
    "eval_date_full",
    "business_id",
    "policy_reference",
    "policy_id",
    "tpa_name",
    "claim_number",
    "claim_id",
    "exposure_number",
    "exposure_id",
    "eff_date",
    "exp_date",
    "acc_date",
    "rpt_date",
    "rpt_lag",
    "rpt_lag_capped",
    "eff_period",
    "acc_period",
    "eval_date_trunc",
    "paid",
    "incurred",
    "incurred_loss_only",
    "incurred_dcc",
    "incurred_ao",
    "incurred_ss",
    "claim_status",
    "exposure_status",
    "claim_lvl_eval_paid",
    "cat_ind",
    "coverage",
    "loss_cause_type_name",
    "cob_group",
    "cob_name",
    "state",
    "in_suit_flag",
    "attorney_authorized_representative_flag",
    "location_of_loss",
)
ATTRIBUTES = (
    "blanket_equip_occ_lim",
    "years_in_bus",
    "prior_loss_hist",
    "revenue_in_12_months",
    "num_of_owners",
    "business_ownership_structure",
    "distribution_channel",
    "agency_aggregator_name",
    "current_agencytype",
    "highest_status_package",
    "highest_status_name",
    "yearly_premium",
    "tria",
    "surcharges",
    "credit_score",
    *CRIMES,
    "new_renewal",
    "cob_industry",
    "channel",
    "carrier_name",
    "num_of_employees",
    "subcont_costs",
    "package_name",
)
COUNTS = (
    "exp_cnt",
    "exp_cnt_paid",
    "exp_cnt_closed",
    "exp_cnt_closed_0paid",
    "exp_cnt_non_cat",
    "count_claim",
    "count_claim_paid",
    "count_claim_closed",
    "count_claim_closed_0paid",
    "count_claim_non_cat",
)
CUMULATIVE = (
    "paid",
    "incurred",
    "incurred_non_cat",
    "incurred_loss_only",
    "incurred_dcc",
    "incurred_ao",
    "incurred_ss",
    *COUNTS,
)
# Order among the rows one exposure has in one month; the marts' sources leave it open.
ROW_TIES = (
    "policy_reference",
    "policy_id",
    "claim_id",
    "claim_number",
    "exposure_number",
    "business_id",
    "tpa_name",
    "coverage",
    "loss_cause_type_name",
    "acc_date",
    "eff_date",
    "exp_date",
    "paid",
    "incurred",
    "incurred_loss_only",
    "incurred_dcc",
    "incurred_ao",
    "cat_ind",
    "cob_group",
    "cob_name",
    "state",
    "in_suit_flag",
    "attorney_authorized_representative_flag",
    "location_of_loss",
)


def _columns(config: MartConfig) -> list[Column | str]:
    return [
        "eval_date",
        F.col("date").alias("eval_date_full"),
        "business_id",
        "policy_reference",
        "tpa_name",
        *named(claim_identity(config)),
        "exposure_number",
        "exposure_id",
        *named(policy_dates()),
        *named(loss_measures()),
        cat_flag("catastrophe_code", NON_CAT_CODES_CLAIMS, NON_CAT_FRAGMENTS_CLAIMS).alias("cat_ind"),
        "coverage",
        "loss_cause_type_name",
        F.col("marketing_cob_group").alias("cob_group"),
        "cob_name",
        F.col("business_state").alias("state"),
        "in_suit_flag",
        "attorney_authorized_representative_flag",
        "location_of_loss",
        F.col("claim_id").alias("_claim"),
    ]


def _lags_and_periods() -> dict[str, Column]:
    """What follows from the distinct columns."""
    return {
        "rpt_lag": report_lag("acc_date", "rpt_date"),
        "rpt_lag_capped": report_lag("acc_date", "rpt_date", REPORT_LAG_CAP),
        "eff_period": periods()["eff_period"],
        "acc_period": periods()["acc_period"],
        "eval_date_trunc": F.trunc("eval_date_full", "month"),
    }


def _rows_at_home(closed: DataFrame, config: MartConfig) -> DataFrame:
    """Distinct exposure rows per month end with amounts, status and report lag, in closed homes; without policy ids."""
    rows = closed.select(*_columns(config), HOME, "date_submitted", cents(total_of(RESERVES)).alias("_reserve"))
    # First report of the claim over all months.
    rows = at_home(rows, {"claim_lvl_eval_paid": F.sum("paid")}, {"rpt_date": F.min("date_submitted")}).drop("date_submitted")
    return rows.withColumn("claim_lvl_eval_paid", F.col("claim_lvl_eval_paid").cast("decimal(28,2)")).distinct().withColumns(_lags_and_periods())


def _other_rows(book: Book, config: MartConfig, ledger: DataFrame, hot: dict[str, Hot]) -> tuple[DataFrame, DataFrame]:
    """The same for any homes, with policy ids: of claims that fit into a task, and of others."""
    rows = ledger.select(*_columns(config))
    open_found = open_in_month(ledger, book.policies, RESERVES, hot, {"claim_lvl_eval_paid": paid_amount()})
    # Written, as the counts read these rows several times and their plan would be in each.
    claims, exposures = [settle(x, "open") for x in open_found]
    # First report of the claim over all months.
    reports = ledger.groupBy(F.col("claim_id").alias("_claim")).agg(F.min("date_submitted").alias("rpt_date"))
    found = [(claims, ["_claim", "eval_date"]), (exposures, ["exposure_id", "eval_date"]), (reports, ["_claim"])]

    def finished(df: DataFrame) -> DataFrame:
        paid = F.coalesce("claim_lvl_eval_paid", F.lit(0)).cast("decimal(28,2)")
        distinct = with_statuses(df).withColumn("claim_lvl_eval_paid", paid).distinct()
        # Each policy id of the reference has the rows, and the rest follows from distinct columns.
        distinct = salted_join(distinct, policy_ids(book.policies), "policy_reference", "left", hot=hot["policy"])
        return distinct.withColumns(_lags_and_periods())

    small, large = beside_claims(rows, ledger, config, hot, ["claim_id"], found)
    return finished(small), finished(large)


def claim_exposures(book: Book, config: MartConfig, ledger: DataFrame, hot: dict[str, Hot]) -> tuple[DataFrame, DataFrame]:
    """Distinct exposure rows per month end with amounts, status and report lag: in closed homes, with the home, and others."""
    closed, other = split_ledger(ledger, book.policies, config, hot)
    at_homes = join_at_home(_rows_at_home(closed, config), in_homes(closed, policy_ids(book.policies), hot), ["policy_reference"])
    small, large = _other_rows(book, config, other, hot)
    return at_homes, small.unionByName(large)


def claim_development(book: Book, config: MartConfig) -> DataFrame:
    """Cumulative amounts, counts and their changes per exposure and month, with policy attributes.

    Attributes are one row per policy reference, so they change no count; they are joined last and the
    wide columns take no part in the earlier shuffles.  Rows of closed homes are moved there once, and ids and attributes come to
    them.  Others are moved to their claims and to their exposures once each; claims and exposures with very many rows are dealt out.
    """
    spine = month_spine(book.periods, config.start, config.through)
    ledger = book_ledger(book.claims_ledger, spine, config)
    hot = hot_in_ledger(ledger, config)
    counted = F.count("exposure_id")
    closed, other = split_ledger(ledger, book.policies, config, hot)

    money = [c for c in CUMULATIVE if c not in COUNTS]
    types = {c: "decimal(15,2)" for c in money} | {c: "decimal(15,6)" for c in COUNTS if c.startswith("count_claim")}
    changes = {c: f"{c}_inc" for c in CUMULATIVE}
    in_force = F.col("eval_date") >= F.col("eff_period")

    def with_measures(df: DataFrame) -> DataFrame:
        return df.withColumns({"incurred_non_cat": non_cat("incurred"), "paid_non_cat": non_cat("paid")})

    at_homes = fractional_counts(_rows_at_home(closed, config).where(in_force), home=HOME)
    # The reference has one policy id at most here, so the id decides no tie.
    ties = [c for c in ROW_TIES if c != "policy_id"]
    at_homes = increments(with_measures(at_homes), [HOME, "exposure_id"], ["eval_date", *ties], changes, types)

    small, large = [x.where(in_force) for x in _other_rows(book, config, other, hot)]
    small = small.withColumn("_n_claim", counted.over(Window.partitionBy("claim_id", "eval_date")))
    large = attach_totals(large, ["claim_id", "eval_date"], {"_n_claim": counted}, hot["trimmed"], ["claim_id"])
    rows = small.unionByName(large)

    def of_large(how: str) -> DataFrame:
        fans = F.broadcast(hot["exposure"].fans.select("_hash"))  # fewer than ``parts`` rows
        return rows.withColumn("_hash", F.xxhash64("exposure_id")).join(fans, "_hash", how).drop("_hash")

    def with_counts(df: DataFrame) -> DataFrame:
        return with_measures(with_shares(df))

    month = Window.partitionBy("exposure_id", "eval_date")
    out = with_counts(of_large("left_anti").repartition("exposure_id").withColumn("_n_exposure", counted.over(month)))
    out = increments(out, "exposure_id", ["eval_date", *ROW_TIES], changes, types)
    # The counts are written already, and without large exposures there are no ranges to write.
    if not hot["exposure"].fans.isEmpty():
        dealt = attach_totals(of_large("inner"), ["exposure_id", "eval_date"], {"_n_exposure": counted}, hot["exposure"], ["exposure_id"])
        out = out.unionByName(increments_of_rows(with_counts(dealt), "exposure_id", "eval_date", ROW_TIES, changes, types))

    attributes = policy_attributes(book, config, spine).select("policy_reference", *ATTRIBUTES)
    known = attributes.where(F.col("policy_reference").isNotNull())
    about = policy_ids(book.policies).join(known, "policy_reference", "full")
    shown = [*EXPOSURE_COLUMNS, *ATTRIBUTES, "incurred_non_cat", "paid_non_cat", *COUNTS, *changes.values()]
    at_homes = join_at_home(at_homes, in_homes(closed, about, hot), ["policy_reference"])
    out = salted_join(out, attributes, "policy_reference", "left", hot=hot["policy"])
    return at_homes.select(*shown).unionByName(out.select(*shown))
