"""Rate change: each policy's re-rated premium beside that of the prior term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.config import MartConfig
from harborbook.functions import guarded_number, json_fields, json_text
from harborbook.functions.jsonfields import fill_defaults
from harborbook.operators.calendars import month_spine
from harborbook.operators.enrich import book_rows, company_metrics, hot_businesses
from harborbook.operators.rating import customer_inception, policy_term, prior_term_pairs, rate_premium
from harborbook.operators.skew import Hot, salted_join
from harborbook.plans.attributes import ALL_TRANS, bound_documents
from harborbook.plans.catalogue import EQUIPMENT_LIMIT, RATE_CHANGE_FIELDS
from harborbook.plans.exposures import named
from harborbook.sources import Book

# Column order of the mart, and what is carried over from the prior term.
CURRENT = (
    "business_id",
    "policy_id",
    "policy_reference",
    "eff_date",
    "exp_date",
    "customer_inception",
    "new_renewal",
    "carrier_name",
    "state",
    "cob_name",
    "cob_group",
    "cob_industry",
    "channel",
    "highest_status_name",
    "policy_term",
    "exposure",
    "pure_premium_total",
    "manual_premium",
    "modified_premium",
    "sold_premium",
)
CARRIED = {
    "highest_status_name": "highest_status_name_prior",
    "policy_term": "policy_term_prior",
    "exposure": "exposure_prior",
    "pure_premium_total": "pure_premium_total_prior",
    "manual_premium": "manual_premium_prior",
    "modified_premium": "modified_premium_prior",
    "sold_premium": "sold_premium_prior",
}


def pricing_breakdown(book: Book, config: MartConfig, hot: Hot | None = None) -> DataFrame:
    """Policies of the book with their term, rating factors and re-rated premium."""
    spine = month_spine(book.periods, config.start, config.through)
    rows = book_rows(book.snapshots, spine, config, ALL_TRANS, positive_term=True)
    base = rows.select(
        "business_id",
        "policy_id",
        "policy_reference",
        "start_date",
        F.col("end_date").cast("date").alias("exp_date"),
        "new_renewal",
        "carrier_name",
        "state",
        "cob_name",
        "cob_group",
        F.coalesce(F.nullif("cob_industry", F.lit("")), F.lit("Construction")).alias("cob_industry"),
        "channel",
    ).distinct()

    documents = bound_documents(book, config, rating=["calculation", "calculation_summary"])
    documents = json_fields(documents, RATE_CHANGE_FIELDS, defaults=False, strict=config.strict_documents, row="policy_id")
    limit = guarded_number(json_text("calculation_summary", *EQUIPMENT_LIMIT, missing="null"), strict=config.strict_documents)
    documents = documents.withColumn("exposure", limit).drop("calculation", "calculation_summary")

    header = book.policies.select("policy_id", F.col("yearly_premium").alias("sold_premium"))
    status = company_metrics(book.company_metrics).select("policy_reference", "highest_status_name")

    wide = base.join(header, "policy_id").join(documents, "policy_id", "left")
    wide = wide.join(status, "policy_reference", "left")
    inception = customer_inception(base).where(F.col("business_id").isNotNull())
    wide = salted_join(wide, inception, "business_id", "left", hot=hot)
    wide = fill_defaults(wide, RATE_CHANGE_FIELDS)
    premium = rate_premium(
        "exposure", "base_premium_loss_cost", "loss_cost_10K", "ded_factor", "base_premium_lcm", "blanket_factor"
    )
    return wide.select(
        "*",
        F.col("start_date").cast("date").alias("eff_date"),
        policy_term("customer_inception", "start_date").alias("policy_term"),
        *named(premium),
    ).withColumnRenamed("pure_premium", "pure_premium_total").drop("start_date")


def rate_change(book: Book, config: MartConfig) -> DataFrame:
    hot = hot_businesses(book.snapshots, config)
    policies = pricing_breakdown(book, config, hot).select(*CURRENT)
    return prior_term_pairs(policies, CARRIED, CURRENT, hot)
