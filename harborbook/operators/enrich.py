"""Policy attributes: premium snapshots joined to everything known about a policy.

The snapshots are by far the largest input, so they are reduced to policy rows first; every lookup is
then joined at policy size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborbook.config import MartConfig
from harborbook.functions import zip5
from harborbook.operators.calendars import up_to_last_month
from harborbook.operators.crime import CRIMES, crime_scores
from harborbook.operators.keys import latest_per_key, top_rank_per_key
from harborbook.operators.skew import Hot, find_hot_keys


def book_rows(
    snapshots: DataFrame, spine: DataFrame, config: MartConfig, trans: Sequence[str], positive_term: bool = False
) -> DataFrame:
    """Snapshot rows of the line, the carriers and the transaction kinds up to the last month end."""
    rows = snapshots.where(
        (F.col("lob") == config.lob) & F.col("carrier_name").isin(*config.carriers) & F.col("trans").isin(*trans)
    )
    rows = up_to_last_month(rows, spine)
    return rows.where(F.col("end_date") > F.col("start_date")) if positive_term else rows


def bind_rows(transactions: DataFrame, lob: str) -> DataFrame:
    return transactions.where((F.col("transaction_type") == "BIND") & (F.col("lob") == lob))


def latest_bind(transactions: DataFrame, lob: str, columns: Sequence[str]) -> DataFrame:
    """Newest bind transaction per policy."""
    binds = bind_rows(transactions, lob)
    order = ["tx_effective_date", "policy_transaction_id"]
    return latest_per_key(binds.select("policy_id", *order, *columns), "policy_id", order).drop(*order)


def latest_quote(quotes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Newest row per quote; of equally new ones the same is picked in every run."""
    wanted = quotes.select("quote_id", "creation_time", *columns).withColumn("_row", F.xxhash64(*columns))
    ties = [c for c in columns if c != "quote_package_data"]
    return latest_per_key(wanted, "quote_id", "creation_time", [*ties, "_row"]).drop("creation_time", "_row")


def latest_rating(rating: DataFrame, lob: str, columns: Sequence[str]) -> DataFrame:
    wanted = rating.where(F.col("lob") == lob).select("job_id", "dateid", "update_time", *columns)
    wanted = wanted.withColumn("_row", F.xxhash64(*columns))
    return latest_per_key(wanted, "job_id", ["dateid", "update_time"], ["_row"]).drop("dateid", "update_time", "_row")


def latest_address(addresses: DataFrame) -> DataFrame:
    columns = ["business_id", "street_address", "zip_code", "county", "creation_time"]
    return latest_per_key(addresses.select(*columns), "business_id", "creation_time", columns[1:4]).drop("creation_time")


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest known credit score per business; different scores of the same moment are all kept."""
    known = scores.where(F.col("score").isNotNull()).select("business_id", "score", "creation_time").distinct()
    newest = top_rank_per_key(known, "business_id", "creation_time")
    return newest.select("business_id", F.col("score").alias("credit_score"))


def business_profile(
    addresses: DataFrame, scores: DataFrame, third_party: DataFrame, property_risk: DataFrame, config: MartConfig
) -> DataFrame:
    """Address, credit score and crime scores per business, so policies need one join instead of three."""
    address = latest_address(addresses).where(F.col("business_id").isNotNull())
    address = address.withColumn("street", F.lower("street_address")).withColumn("zip_code_5digit", zip5("zip_code"))
    crimes = crime_scores(third_party, property_risk, config.crime_provider, at=address.select("street", "zip_code_5digit"))
    crimes = crimes.drop("creation_time")
    address = address.join(crimes, ["street", "zip_code_5digit"], "left")
    scored = latest_scores(scores).where(F.col("business_id").isNotNull())
    # A business may be known to either source alone.
    profile = address.join(scored, "business_id", "full")
    return profile.select("business_id", F.col("county").alias("address_county"), "zip_code", "credit_score", *CRIMES)


def company_metrics(metrics: DataFrame) -> DataFrame:
    """Distribution attributes under the names the marts use."""
    return metrics.where(F.col("policy_reference").isNotNull()).select(
        "policy_reference",
        F.col("distribution_channel_attributed").alias("distribution_channel"),
        F.col("agency_aggregator").alias("agency_aggregator_name"),
        F.col("agency_type").alias("current_agencytype"),
        F.col("package").alias("highest_status_package"),
        F.col("policy_status_name").alias("highest_status_name"),
    )


def newest_policy_row(rows: DataFrame, tie_break: Sequence[str], then: Sequence[Column] = ()) -> DataFrame:
    """The row with the latest ``eff_date`` per policy reference, ``then`` deciding before ``tie_break``."""
    return latest_per_key(rows, "policy_reference", [F.desc_nulls_last("eff_date"), *then], tie_break)


def hot_businesses(snapshots: DataFrame, config: MartConfig) -> Hot:
    """Businesses with very many snapshot rows."""
    rows = snapshots.where((F.col("lob") == config.lob) & F.col("carrier_name").isin(*config.carriers))
    return find_hot_keys(rows, {"business": ["business_id"]}, config.hot_parts)["business"]


def activity_spine(keyed: DataFrame, spine: DataFrame, has_premium: str, loss_map: str) -> DataFrame:
    """Key-month pairs with premium or loss out of one row per key.

    A key with premium has every month of the spine, a key with losses alone the months of its losses.
    Everything of a key stays in one row until the broadcast spine lays it out, so the grid is not shuffled.
    """
    has_loss = F.coalesce(F.map_contains_key(loss_map, F.col("eval_date")), F.lit(False))
    return keyed.crossJoin(F.broadcast(spine)).where(F.col(has_premium) | has_loss)
