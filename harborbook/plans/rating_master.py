"""Rating master: one row per policy with every rating factor, limit and premium component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.config import INCEPTION_TRANS, MartConfig
from harborbook.functions import blank_to_null, json_fields, nz, yyyymm
from harborbook.functions.jsonfields import checked_json, fill_defaults, json_paths
from harborbook.operators.calendars import month_spine
from harborbook.operators.crime import CRIMES
from harborbook.operators.enrich import (
    book_rows,
    business_profile,
    company_metrics,
    hot_businesses,
    newest_policy_row,
)
from harborbook.operators.keys import latest_per_key
from harborbook.operators.losses import lifetime_losses
from harborbook.operators.skew import salted_join
from harborbook.operators.rating import base_premium_fallback, tria_indicator
from harborbook.plans.attributes import bound_documents
from harborbook.plans.catalogue import CALCULATED_BASE_PREMIUM, FINAL_BASE_PREMIUM, RATING_MASTER_FIELDS
from harborbook.sources import Book

_LAST = ("additional_coverage_premium", "optional_coverage_premium", "minimum_premium", "state_surcharge_rate")
_FACTORS = tuple(f.name for f in RATING_MASTER_FIELDS if f.name not in _LAST)

# Column order of the mart.
COLUMNS = (
    "policy_reference",
    "policy_id",
    "business_id",
    "new_renewal",
    "yearly_premium",
    "purch_date",
    "eff_date",
    "exp_date",
    "eff_period",
    "county",
    "zip_code",
    "state",
    "highest_status_package",
    "highest_status_name",
    "cob_name",
    "cob_group",
    "cob_industry",
    "carrier",
    "carrier_name",
    "channel",
    *_FACTORS,
    "tria_ind",
    "tria_premium",
    "state_surcharge_rate",
    "base_premium",
    "additional_coverage_premium",
    "optional_coverage_premium",
    "minimum_premium",
    "credit_score",
    "crime_score_arson",
    "crime_score_burglary",
    "crime_score_larceny",
    "crime_score_autotheft",
    "incurred_loss",
    "paid_loss",
    "claim_count",
    "non_zero_claim_count",
)

SNAPSHOT_TIES = (
    "policy_id",
    "business_id",
    "exp_date",
    "new_renewal",
    "state",
    "cob_name",
    "cob_group",
    "cob_industry",
    "carrier_name",
    "channel",
)
LOOKUP_TIES = ("yearly_premium", "purch_date", "tria_premium", "highest_status_name", "credit_score", *CRIMES)


def rating_master(book: Book, config: MartConfig) -> DataFrame:
    spine = month_spine(book.periods, config.start, config.rating_through)
    rows = book_rows(book.snapshots, spine, config, INCEPTION_TRANS, positive_term=True)
    rows = rows.select(
        "policy_reference",
        F.col("start_date").cast("date").alias("eff_date"),
        F.col("end_date").cast("date").alias("exp_date"),
        *[c for c in SNAPSHOT_TIES if c not in ("exp_date", "cob_industry")],
        F.coalesce(blank_to_null("cob_industry"), F.lit("Construction")).alias("cob_industry"),
    )
    base = newest_policy_row(rows, SNAPSHOT_TIES)

    documents = bound_documents(
        book, config, bind=["package_name"], quote=["quote_package_data"], rating=["calculation"]
    )
    if config.strict_documents:
        documents = checked_json(documents, ["calculation", "quote_package_data"], "policy_id")
    texts = {"_final": FINAL_BASE_PREMIUM, "_calculated": CALCULATED_BASE_PREMIUM}
    documents = json_paths(documents, "calculation", texts)
    documents = json_fields(documents, RATING_MASTER_FIELDS, defaults=False, strict=config.strict_documents, row="policy_id")
    documents = documents.withColumn("base_premium", base_premium_fallback("_final", "_calculated"))
    documents = documents.drop("calculation", "quote_package_data", *texts)

    header = book.policies.where("policy_id is not null").select(
        "policy_id",
        "yearly_premium",
        F.col("bind_date").cast("date").alias("purch_date"),
        F.col("tria").alias("tria_premium"),
    )
    profile = business_profile(book.addresses, book.scores, book.third_party, book.property_risk, config)
    status = company_metrics(book.company_metrics).select("policy_reference", "highest_status_name")
    losses = lifetime_losses(book.claims_ledger, config.lob).where(F.col("policy_reference").isNotNull())

    wide = base.join(header, "policy_id", "left").join(documents, "policy_id", "left")
    wide = wide.join(status, "policy_reference", "left").join(losses, "policy_reference", "left")
    profile = profile.withColumnRenamed("address_county", "county")
    wide = salted_join(wide, profile, "business_id", "left", hot=hot_businesses(book.snapshots, config))
    wide = latest_per_key(wide, "policy_reference", "eff_date", LOOKUP_TIES)
    wide = fill_defaults(wide, RATING_MASTER_FIELDS)
    wide = wide.withColumns(
        {
            "eff_period": yyyymm("eff_date"),
            "carrier": F.col("carrier_name"),
            "highest_status_package": F.col("package_name"),
            "tria_ind": tria_indicator("tria_premium"),
            **{f"crime_score_{c.lower()}": F.col(c) for c in CRIMES},
            **{c: nz(c).cast("decimal(28,2)") for c in ("incurred_loss", "paid_loss")},
            **{c: nz(c) for c in ("claim_count", "non_zero_claim_count")},
        }
    )
    return wide.select(*COLUMNS)
