"""Crime scores per address from two vendors' JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.functions import blank_to_null, zip5
from harborbook.functions.jsonfields import json_paths
from harborbook.operators.keys import latest_per_key
from harborbook.operators.lookups import likely_wanted

# Where the vendor keeps a score and the address.
CRIMES = ("Arson", "Burglary", "Larceny", "AutoTheft")
SCORE_AT = ("IndexValuesUpto10", "Current")
STREET_AT = ("Address", "StreetAddress1")
ZIP_AT = ("Address", "Zip")


def _read(rows: DataFrame, doc: str, street: str | None = None, zip_code: str | None = None) -> DataFrame:
    """Scores and address of each valid document, even one without a score, parsed once; a missing text is empty.

    The address is that of the document unless its columns are named.
    """
    paths = {c: ("Ms3", "Crime", c, *SCORE_AT) for c in CRIMES}
    if street is None or zip_code is None:
        paths |= {"_street": STREET_AT, "_zip": ZIP_AT}
        street, zip_code = "coalesce(_street, '')", "coalesce(_zip, '')"
    valid = rows.where(F.get_json_object(doc, "$").isNotNull())
    return json_paths(valid, doc, paths).select(
        *[blank_to_null(c).try_cast("int").alias(c) for c in CRIMES],
        F.lower(F.expr(street)).alias("street"),
        zip5(F.expr(zip_code)).alias("zip_code_5digit"),
        "creation_time",
    )


def crime_scores(third_party: DataFrame, property_risk: DataFrame, provider: str, at: DataFrame | None = None) -> DataFrame:
    """Newest scores per ``(street, zip_code_5digit)`` of both sources together; with ``at`` (street, zip code) at least for those."""
    vendor = _read(third_party.where(F.col("provider") == provider), "response_data")
    both = vendor.unionByName(_read(property_risk, "verisk_json_response", "street", "zip_code"))
    if at is not None:
        both = likely_wanted(both, ["street", "zip_code_5digit"], at)
    return latest_per_key(both.distinct(), ["street", "zip_code_5digit"], "creation_time", CRIMES)
