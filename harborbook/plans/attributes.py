"""Policy attributes shared by the marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.config import EARNED_TRANS, WRITTEN_TRANS, MartConfig
from harborbook.functions import days_between, guarded_number, json_text, yyyymm
from harborbook.operators.crime import CRIMES
from harborbook.operators.enrich import (
    bind_rows,
    book_rows,
    business_profile,
    company_metrics,
    hot_businesses,
    latest_bind,
    latest_quote,
    latest_rating,
    newest_policy_row,
)
from harborbook.operators.keys import latest_per_key
from harborbook.operators.lookups import likely_wanted
from harborbook.operators.losses import prior_loss_flag
from harborbook.operators.skew import salted_join
from harborbook.plans.catalogue import EQUIPMENT_LIMIT, SUBCONTRACTOR_COST
from harborbook.sources import Book

ALL_TRANS = EARNED_TRANS + WRITTEN_TRANS

SNAPSHOT_ATTRIBUTES = (
    "policy_id",
    "business_id",
    "exp_date",
    "state",
    "county",
    "new_renewal",
    "cob_name",
    "cob_group",
    "cob_industry",
    "carrier_name",
    "channel",
    "affiliate_name",
)


def bound_documents(
    book: Book,
    config: MartConfig,
    bind: Sequence[str] = (),
    quote: Sequence[str] = (),
    rating: Sequence[str] = (),
) -> DataFrame:
    """Newest bind of each policy with its quote and the rating of that quote.

    Quotes that no bind names, and ratings of no such quote, are left out before the newest ones are chosen, so their
    documents are neither moved nor sorted.
    """
    transactions = book.policy_transactions.where("policy_id is not null")
    binds = latest_bind(transactions, config.lob, ["last_quote_id", *bind])
    quotes = likely_wanted(book.quotes, ["quote_id"], bind_rows(transactions, config.lob).select("last_quote_id"))
    ratings = likely_wanted(book.rating, ["job_id"], quotes.select("job_id"))
    quotes = latest_quote(quotes, ["job_id", *quote]).withColumnRenamed("quote_id", "last_quote_id")
    ratings = latest_rating(ratings, config.lob, rating)
    return binds.join(quotes, "last_quote_id", "left").join(ratings, "job_id", "left").drop("last_quote_id", "job_id")


def snapshot_attributes(rows: DataFrame) -> DataFrame:
    """Attribute columns of snapshot rows under the names of the marts."""
    dated = rows.withColumn("eff_date", F.col("start_date").cast("date")).withColumn(
        "exp_date", F.col("end_date").cast("date")
    )
    return dated.select("policy_reference", "eff_date", "status_name", *SNAPSHOT_ATTRIBUTES)


def policy_attributes(book: Book, config: MartConfig, spine: DataFrame) -> DataFrame:
    """One row per policy reference: its newest snapshot and everything looked up for it.

    The snapshot row is chosen before anything is joined, which picks the same row as joining first:
    only its own columns decide.  Lookups that still give a policy several rows are cut to one at the end.
    """
    rows = snapshot_attributes(book_rows(book.snapshots, spine, config, ALL_TRANS))
    rows = rows.where(F.col("policy_reference").isNotNull())
    base = newest_policy_row(rows, SNAPSHOT_ATTRIBUTES, [F.asc_nulls_last("status_name")])

    documents = bound_documents(
        book,
        config,
        bind=[
            "package_name",
            "business_ownership_structure",
            "num_of_owners",
            "revenue_next_12_months",
            "year_business_started",
        ],
        quote=["offer_id"],
        rating=["calculation_summary"],
    )
    documents = documents.withColumn(
        "blanket_equip_occ_lim",
        guarded_number(json_text("calculation_summary", *EQUIPMENT_LIMIT, missing="null"), strict=config.strict_documents),
    ).drop("calculation_summary")
    answers = book.submissions.where("first_offer_id is not null")
    cost = guarded_number(json_text("questionnaire_answers", *SUBCONTRACTOR_COST, missing="null"), strict=config.strict_documents)
    answers = answers.select(F.col("first_offer_id").alias("offer_id"), "num_of_employees", cost.alias("subcont_costs"))
    documents = documents.join(answers, "offer_id", "left").drop("offer_id")

    header = book.policies.where("policy_id is not null").select(
        "policy_id", "yearly_premium", "tria", "surcharges", F.col("bind_date").cast("date").alias("_bound")
    )
    prior = prior_loss_flag(book.claims_ledger, book.policies, config.lob)
    prior = prior.select("policy_reference", "prior_loss_hist").distinct()
    profile = business_profile(book.addresses, book.scores, book.third_party, book.property_risk, config)

    wide = base.join(documents, "policy_id", "left").join(header, "policy_id", "left")
    wide = wide.join(prior, "policy_reference", "left")
    wide = wide.join(company_metrics(book.company_metrics), "policy_reference", "left")
    profile = profile.drop("address_county", "zip_code")
    wide = salted_join(wide, profile, "business_id", "left", hot=hot_businesses(book.snapshots, config))
    wide = wide.select(
        "*",
        yyyymm("eff_date").alias("eff_period"),
        F.col("revenue_next_12_months").alias("revenue_in_12_months"),
        (F.year("eff_date") - F.col("year_business_started")).alias("years_in_bus"),
        days_between("_bound", "eff_date").alias("days_between_bind_to_policy_start"),
    ).drop("revenue_next_12_months", "year_business_started", "_bound")
    return latest_per_key(wide, "policy_reference", [F.desc_nulls_last("eff_date")], LOOKUP_TIES)


# Order among the rows several lookups give one policy; the marts' sources leave it open.
LOOKUP_TIES = (
    "num_of_employees",
    "subcont_costs",
    "yearly_premium",
    "tria",
    "surcharges",
    "days_between_bind_to_policy_start",
    "prior_loss_hist",
    "distribution_channel",
    "agency_aggregator_name",
    "current_agencytype",
    "highest_status_package",
    "highest_status_name",
    "credit_score",
    *CRIMES,
)
