"""The thirteen input tables of the marts, derived from the given tables.

Each view is one SQL text that Spark and DuckDB both understand, so the marts and the checking SQL start
from the same rows.  Suppliers write policies (one per supplier and year of shipping), line items are
premium transactions, and returned line items are claims with month-end snapshots.  Every row of the
given tables takes part; missing, tied, misspelt and unreadable values are there on purpose.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from harborbook import MartConfig
from harborbook.operators.lineage import shared_folder
from harborbook.plans.catalogue import (
    BORROWED_EQUIPMENT_PREMIUM,
    CALCULATED_BASE_PREMIUM,
    COVERAGE_FIELDS,
    EQUIPMENT_LIMIT,
    FINAL_BASE_PREMIUM,
    MISC_TOOLS_PREMIUM,
    RATE_CHANGE_FIELDS,
    RATING_MASTER_FIELDS,
)
from harborbook.sources import Book, conform, write_mart

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

CONFIG = MartConfig(
    carriers=("carrier-one", "carrier-two", "carrier-three"),
    as_of=date(2001, 7, 20),
    start=date(1995, 1, 1),
    rating_through=date(2001, 6, 30),
)

# Policies of a book: supplier and year of shipping.  Some suppliers keep one reference for two years.
TERMS = """
SELECT DISTINCT l_suppkey AS sk, CAST(year(l_shipdate) AS INT) AS yr
FROM lineitem"""

POLICY_KEYS = """
SELECT t.sk, t.yr, s.s_name, s.s_acctbal, n.n_name, s.s_nationkey,
       'ID-' || CAST(t.sk AS STRING) || '-' || CAST(t.yr AS STRING) AS policy_id,
       'P-' || CAST(t.sk AS STRING) || '-' || CAST(CASE WHEN t.sk % 10 = 3 AND t.yr = 1997 THEN 1996 ELSE t.yr END AS STRING)
         AS policy_reference,
       'B-' || CAST(t.sk - t.sk % 2 AS STRING) AS business_id,
       CAST(t.yr AS STRING) || CASE WHEN t.sk % 9 = 4 THEN '-03-' ELSE '-01-' END
         || lpad(CAST(1 + t.sk % 28 AS STRING), 2, '0') AS starts,
       CAST(t.yr + CASE WHEN t.sk % 20 = 7 AND t.yr = 1999 THEN 0 ELSE 1 END AS STRING)
         || CASE WHEN t.sk % 9 = 4 THEN '-03-' ELSE '-01-' END
         || lpad(CAST(1 + t.sk % 28 AS STRING), 2, '0') AS ends,
       CASE WHEN t.sk % 25 = 24 THEN 'other-carrier' WHEN t.sk % 4 = 1 THEN 'carrier-two'
            WHEN t.sk % 4 = 2 THEN 'carrier-three' ELSE 'carrier-one' END AS carrier_name,
       CASE s.s_nationkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'NY' END AS state
FROM terms t JOIN supplier s ON s.s_suppkey = t.sk JOIN nation n ON n.n_nationkey = s.s_nationkey"""

PERIODS = """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, last_day(CAST(o_orderdate AS DATE)) AS monthlastday
FROM orders"""

SNAPSHOTS = """
SELECT CAST(l.l_shipdate AS DATE) AS date, k.policy_id, k.policy_reference, k.business_id,
       CASE WHEN l.l_linenumber = 7 THEN 'GL' ELSE 'IM' END AS lob, k.carrier_name,
       CASE WHEN l.l_linenumber = 1 THEN CASE WHEN k.yr = 1995 THEN 'New' ELSE 'Renewal' END
            WHEN l.l_linenumber = 2 AND l.l_returnflag = 'A' THEN 'Cancellation - New'
            WHEN l.l_linenumber = 2 AND l.l_returnflag = 'N' THEN 'Cancellation - Renewal'
            WHEN l.l_linenumber = 2 AND l.l_linestatus = 'F' THEN 'Undo Cancellation - New'
            WHEN l.l_linenumber = 2 THEN 'Undo Cancellation - Renewal'
            WHEN l.l_linenumber IN (3, 4) THEN 'monthly earned premium'
            WHEN l.l_linenumber = 5 THEN 'monthly earned premium endorsement'
            ELSE 'installment fee' END AS trans,
       CASE WHEN l.l_quantity = 13 THEN NULL
            WHEN l.l_linenumber = 2 AND l.l_returnflag <> 'R' THEN -CAST(l.l_extendedprice AS DECIMAL(18,2))
            ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS dollar_amount,
       CAST(CASE WHEN k.sk % 10 = 6 AND l.l_returnflag = 'A' THEN CAST(k.yr AS STRING) || '-04-15' ELSE k.starts END
            AS TIMESTAMP) AS start_date,
       CAST(k.ends AS TIMESTAMP) AS end_date,
       k.state, k.n_name AS county,
       CASE l.l_linestatus WHEN 'F' THEN 'Active' ELSE 'Bound' END AS status_name,
       CASE WHEN k.yr = 1995 THEN 'new' ELSE 'renewal' END AS new_renewal,
       CASE WHEN k.sk % 10 = 5 AND l.l_returnflag = 'R' THEN 'Roofing' WHEN k.sk % 2 = 0 THEN 'Carpentry'
            ELSE 'Plumbing' END AS cob_name,
       CASE WHEN k.sk % 2 = 0 THEN 'Wood' ELSE 'Water' END AS cob_group,
       CASE k.sk % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Retail' END AS cob_industry,
       CASE k.sk % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Agent' ELSE 'Partner' END AS channel,
       CASE WHEN k.sk % 6 = 0 THEN 'Affiliate ' || k.n_name END AS affiliate_name
FROM lineitem l JOIN policy_keys k ON k.sk = l.l_suppkey AND k.yr = year(l.l_shipdate)"""

# A supplier with a negative balance has no policy header.
POLICIES = """
SELECT policy_id, policy_reference, business_id,
       CAST(CAST(s_acctbal AS DECIMAL(18,2)) + CAST(yr AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS yearly_premium,
       CASE sk % 3 WHEN 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN 1 THEN NULL ELSE CAST(12.50 AS DECIMAL(18,2)) END AS tria,
       CAST(sk % 7 AS DECIMAL(18,2)) AS surcharges,
       CAST(CAST(yr - 1 AS STRING) || '-12-' || lpad(CAST(1 + sk % 28 AS STRING), 2, '0') AS TIMESTAMP) AS bind_date
FROM policy_keys
WHERE s_acctbal >= 0"""

# Returned line items; an item reappears at six month ends and, to be passed over, once in mid-month.
ITEMS = """
SELECT l.*, CAST(year(l_shipdate) AS INT) AS yr, CAST(l_shipdate AS DATE) AS ship, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
FROM lineitem l WHERE l_returnflag = 'R'"""

AGES = "SELECT 0 AS age UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 99"

LEDGER = """
SELECT CASE WHEN a.age = 99 THEN CAST(last_day(i.ship) - INTERVAL '15' DAY AS DATE)
            ELSE last_day(CAST(i.ship + INTERVAL '1' MONTH * a.age AS DATE)) END AS date,
       'C' || lpad(CAST(i.l_orderkey AS STRING), 12, '0')
         || CASE WHEN i.l_linenumber <= 3 THEN '-' || i.l_linestatus ELSE '' END AS claim_id,
       'N' || lpad(CAST(i.l_orderkey AS STRING), 12, '0')
         || CASE WHEN i.l_linenumber <= 3 THEN '-' || i.l_linestatus ELSE '' END AS claim_number,
       'E-' || CAST(i.l_orderkey AS STRING) || '-' || CAST(i.l_linenumber AS STRING) || '-' || CAST(i.l_partkey AS STRING)
         || '-' || CAST(i.l_suppkey AS STRING) AS exposure_id,
       CASE WHEN i.l_quantity = 17 THEN NULL ELSE CAST(i.l_linenumber AS STRING) END AS exposure_number,
       CASE WHEN i.l_quantity = 29 THEN NULL ELSE k.policy_reference END AS policy_reference,
       k.business_id, CASE WHEN i.l_quantity = 31 THEN 'GL' ELSE 'IM' END AS lob, k.carrier_name,
       CASE WHEN i.l_linenumber <= 3 THEN 'Gallagher Bassett' WHEN i.l_linenumber = 4 THEN NULL ELSE 'In House' END AS tpa_name,
       CAST(k.starts AS TIMESTAMP) AS policy_start_date, CAST(k.ends AS TIMESTAMP) AS policy_end_date,
       i.ship AS date_of_loss, CAST(i.ship + INTERVAL '1' DAY * CAST(i.l_quantity * 2 AS INT) AS DATE) AS date_submitted,
       CASE WHEN i.l_linenumber = 6 THEN NULL WHEN i.l_linenumber = 5 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(i.price * 0.05 * (CASE WHEN a.age = 99 THEN 9 ELSE a.age END) AS DECIMAL(18,2)) END AS loss_paid_total,
       CASE WHEN i.l_linenumber < 5 THEN CAST(i.price * 0.01 AS DECIMAL(18,2)) END AS expense_ao_paid_total,
       CASE WHEN i.l_linenumber = 3 THEN CAST(i.price * 0.02 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
         AS expense_dcc_paid_total,
       CASE WHEN i.l_linenumber = 4 THEN -CAST(i.price * 0.03 AS DECIMAL(18,2)) END AS recovery_salvage_collected_total,
       CASE WHEN i.l_linenumber = 2 THEN -CAST(i.price * 0.04 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
         AS recovery_subrogation_collected_total,
       CASE WHEN a.age >= 3 AND i.l_linenumber % 2 = 0 THEN CAST(0 AS DECIMAL(18,2))
            WHEN i.l_linenumber = 7 THEN NULL
            ELSE CAST(i.price * 0.10 * (5 - CASE WHEN a.age = 99 THEN 0 ELSE a.age END) AS DECIMAL(18,2)) END AS loss_reserve_total,
       CASE WHEN a.age < 2 THEN CAST(i.price * 0.01 AS DECIMAL(18,2)) END AS expense_ao_reserve_total,
       CASE WHEN a.age < 1 THEN CAST(i.price * 0.02 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS expense_dcc_reserve_total,
       CASE WHEN i.l_linenumber = 1 THEN -CAST(i.price * 0.25 AS DECIMAL(18,2)) END AS recovery_salvage_reserve_total,
       CASE WHEN i.l_linenumber = 3 THEN -CAST(i.price * 0.15 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
         AS recovery_subrogation_reserve_total,
       CASE i.l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'SIU' WHEN 3 THEN 'COVID19' WHEN 4 THEN 'Subro-12'
            WHEN 5 THEN 'CAT-55' WHEN 6 THEN 'HSB' WHEN 7 THEN 'old SALVage' ELSE '1111/BFA' END AS catastrophe_code,
       CASE i.l_partkey % 14 WHEN 0 THEN 'BLANKET_EQUIPMENT' WHEN 1 THEN 'BLANKET_MISC' WHEN 2 THEN 'BLANKET_EQUIP'
            WHEN 3 THEN 'DEBRIS_REMOVAL' WHEN 4 THEN 'EMPLOYEE_TOOLS_AND_CLOTHING' WHEN 5 THEN 'EMPLOYEE_TOOlS_AND_CLOTHING'
            WHEN 6 THEN 'EQUIPMENT_BORROWED_FROM_OTHERS' WHEN 7 THEN 'FIRE_DEPARTMENT_SERVICE_CHARGE'
            WHEN 8 THEN 'FUEL_ACCESSORIES_AND_SPARE_PARTS' WHEN 9 THEN 'RENTAL_REIMBURSEMENT' WHEN 10 THEN 'REWARDS'
            WHEN 11 THEN 'TRAILERS_AND_CONTENTS' WHEN 12 THEN NULL ELSE 'FALSE_PRETENSE' END AS coverage,
       CASE i.l_partkey % 11 WHEN 0 THEN 'FIRE' WHEN 1 THEN 'SMOKE' WHEN 2 THEN 'LIGHTNING' WHEN 3 THEN 'THEFT_OTHER'
            WHEN 4 THEN 'VANDALISM' WHEN 5 THEN 'EQUIPMENT_BREAKDOWN_MECHANICAL' WHEN 6 THEN 'EQUIPMENTXBREAKDOWN'
            WHEN 7 THEN 'CIVIL_COMMOTION' WHEN 8 THEN NULL WHEN 9 THEN 'COLLISION' ELSE 'EXPLOSION' END AS loss_cause_type_name,
       CASE WHEN k.sk % 2 = 0 THEN 'Wood' ELSE 'Water' END AS marketing_cob_group,
       CASE WHEN k.sk % 2 = 0 THEN 'Carpentry' ELSE 'Plumbing' END AS cob_name,
       CASE WHEN i.l_quantity = 11 THEN NULL ELSE k.state END AS business_state,
       k.n_name AS location_of_loss,
       CASE WHEN i.l_quantity > 40 THEN 'Y' ELSE 'N' END AS in_suit_flag,
       CASE WHEN i.l_quantity > 45 THEN 'Y' END AS attorney_authorized_representative_flag,
       CASE i.l_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN '123' WHEN 3 THEN '12345-6789' WHEN 4 THEN NULL
            ELSE '94107' END AS accident_zip_code
FROM items i CROSS JOIN ages a JOIN policy_keys k ON k.sk = i.l_suppkey AND k.yr = i.yr"""

ADDRESSES = """
SELECT 'B-' || CAST(s_suppkey - s_suppkey % 2 AS STRING) AS business_id, s_name || ' Street' AS street_address,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 8 = 1 THEN '12345-6789'
            ELSE CAST(s_suppkey * 37 AS STRING) END AS zip_code,
       n_name AS county,
       TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey AS INT) AS creation_time
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""

# Two suppliers of one business often tie on the time of their score.
SCORES = """
SELECT 'B-' || CAST(s_suppkey - s_suppkey % 2 AS STRING) AS business_id,
       CASE WHEN s_acctbal < 1000 THEN NULL ELSE CAST(floor(s_acctbal / 100) AS INT) END AS score,
       TIMESTAMP '2000-01-01 00:00:00'
         + INTERVAL '1' HOUR * CAST(CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey - s_suppkey % 2 ELSE s_suppkey END AS INT) AS creation_time
FROM supplier"""

VERSIONS = "SELECT 1 AS ver UNION ALL SELECT 2"

POLICY_TRANSACTIONS = """
SELECT k.policy_id, 'T-' || CAST(v.ver AS STRING) || '-' || k.policy_id AS policy_transaction_id,
       CAST(CAST(k.yr AS STRING) || CASE WHEN k.sk % 5 = 1 THEN '-02-01' ELSE '-02-0' || CAST(v.ver AS STRING) END AS DATE)
         AS tx_effective_date,
       CASE WHEN v.ver = 2 AND k.sk % 7 = 2 THEN 'ENDORSE' ELSE 'BIND' END AS transaction_type,
       CASE WHEN v.ver = 2 AND k.sk % 7 = 3 THEN 'GL' ELSE 'IM' END AS lob,
       CASE WHEN k.sk % 15 = 14 THEN NULL
            ELSE 'Q-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) || '-' || CAST(v.ver AS STRING) END AS last_quote_id,
       CASE v.ver WHEN 1 THEN 'Basic' ELSE 'Pro' END AS package_name,
       CASE k.sk % 3 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Corporation' ELSE NULL END AS business_ownership_structure,
       CAST(1 + k.sk % 4 AS INT) AS num_of_owners,
       CAST(CAST(k.s_acctbal AS DECIMAL(18,2)) * 12 AS DECIMAL(18,2)) AS revenue_next_12_months,
       CAST(1980 + k.sk % 20 AS INT) AS year_business_started
FROM policy_keys k CROSS JOIN versions v
WHERE k.s_acctbal < 9000"""

SUBMISSIONS = """
SELECT 'O-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) AS first_offer_id,
       CAST(v.ver * 3 + k.sk % 5 AS INT) AS num_of_employees,
       CASE k.sk % 6 WHEN 0 THEN '{"location.subcontractors_cost": "1000"}' WHEN 1 THEN '{"location.subcontractors_cost": "10.5"}'
            WHEN 2 THEN '{"location.subcontractors_cost": "1.2.3"}' WHEN 3 THEN '{"location": {"subcontractors_cost": "7"}}'
            WHEN 4 THEN '{bad' ELSE '{"location.subcontractors_cost": "abc"}' END AS questionnaire_answers
FROM policy_keys k CROSS JOIN versions v
WHERE v.ver = 1 OR k.s_nationkey = 8"""

_SCORE_DOC = """'{"Address": {"StreetAddress1": "' || {street} || '", "Zip": "' || {zip} || '"}, "Ms3": {"Crime": {'
       || CASE WHEN s_suppkey % 9 = 2 THEN '' ELSE '"Arson": {"IndexValuesUpto10": {"Current": "' || CAST(s_suppkey % 10 AS STRING) || '"}}, ' END
       || '"Burglary": {"IndexValuesUpto10": {"Current": ' || CAST(s_suppkey % 8 AS STRING) || '}}, '
       || '"Larceny": {"IndexValuesUpto10": {"Current": "' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey % 6 AS STRING) END || '"}}, '
       || '"AutoTheft": {"IndexValuesUpto10": {"Current": "' || CAST(s_suppkey % 4 AS STRING) || '"}}}}}'"""

THIRD_PARTY = f"""
SELECT CASE WHEN s_suppkey % 10 = 9 THEN 'Another' ELSE 'Verisk' END AS provider,
       CASE WHEN s_suppkey % 11 = 4 THEN '{{bad' WHEN s_suppkey % 11 = 6 THEN NULL WHEN s_suppkey % 11 = 8 THEN '{{}}'
            ELSE {_SCORE_DOC.replace("{street}", "upper(s_name) || ' STREET'").replace("{zip}", "CAST(s_suppkey * 37 AS STRING)")}
       END AS response_data,
       TIMESTAMP '2000-02-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey AS INT) AS creation_time
FROM supplier"""

PROPERTY_RISK = f"""
SELECT CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE
       {_SCORE_DOC.replace("{street}", "'x'").replace("{zip}", "'1'").replace("s_suppkey % 10 AS", "s_suppkey % 3 AS")} END AS verisk_json_response,
       s_name || ' Street' AS street, CAST(s_suppkey * 37 AS STRING) AS zip_code,
       TIMESTAMP '2000-02-01 00:00:00' + INTERVAL '1' HOUR * CAST(CASE WHEN s_acctbal < 5000 THEN 0 ELSE 100000 END AS INT) AS creation_time
FROM supplier"""

METRICS = """
SELECT DISTINCT policy_reference,
       CASE sk % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Expired' ELSE 'Cancelled' END AS policy_status_name,
       CASE sk % 2 WHEN 0 THEN 'Basic' ELSE 'Pro' END AS package,
       CASE sk % 4 WHEN 0 THEN 'Web' WHEN 1 THEN 'Phone' ELSE 'Agent' END AS distribution_channel_attributed,
       CASE WHEN sk % 5 = 0 THEN 'Aggregator ' || CAST(sk % 7 AS STRING) END AS agency_aggregator,
       CASE WHEN sk % 4 > 1 THEN 'Local' END AS agency_type
FROM policy_keys
WHERE s_acctbal < 9500"""


# --- rating and quote documents, laid out after the field catalogue ----------------------------


SLOTS = 8  # numbers that vary from document to document
SHAPES = 5  # each shape leaves other keys out, blank or misspelt


def _value(i: int, dtype: str, split: bool, shape: int) -> str:
    """JSON value of the i-th field; ``#n`` stands for a number of the document."""
    slot = f"#{i % SLOTS}"
    if i % 11 == shape:
        return '""'
    if i % 13 == shape:
        return '"n/a"'
    if split:
        return f'"0.{slot}|table{i}"'
    if dtype == "decimal(18,0)":
        return f'"{slot}{i % 10}0.50"' if i % 2 else f"{slot}{i % 7}00"
    return f'"{i % 3}.{slot}"' if i % 2 else f"{i % 3}.{slot}"


def _object(tree: dict, shape: int) -> str:
    parts = []
    for key, node in tree.items():
        if isinstance(node, dict):
            parts.append(f'"{key}": {_object(node, shape)}')
        elif node[0] % 7 != shape:
            parts.append(f'"{key}": {_value(*node, shape)}')
    return "{" + ", ".join(parts) + "}"


def _document(paths: list[tuple[tuple[str, ...], str, bool]]) -> str:
    """SQL for a JSON document that holds the fields at ``paths``."""
    tree: dict = {}
    for i, (path, dtype, split) in enumerate(paths):
        node = tree
        for key in path[:-1]:
            node = node.setdefault(key, {})
        node.setdefault(path[-1], (i, dtype, split))
    sql = f"CASE k.sk % {SHAPES} " + " ".join(
        f"WHEN {shape} THEN '{_object(tree, shape)}'" for shape in range(SHAPES)
    ) + " END"
    for slot in range(SLOTS):
        number = f"CAST(10 + (k.sk * 7 + k.yr * {slot + 1} + v.ver * 3 + {slot * 5}) % 90 AS STRING)"
        sql = f"replace({sql}, '#{slot}', {number})"
    return sql


def _paths(source: str) -> list[tuple[tuple[str, ...], str, bool]]:
    fields = [f for f in (*RATING_MASTER_FIELDS, *COVERAGE_FIELDS, *RATE_CHANGE_FIELDS) if f.source == source]
    known = {f.path: (f.path, f.dtype, f.split) for f in reversed(fields)}
    extra = {
        "calculation": [(p, "decimal(18,0)", p == CALCULATED_BASE_PREMIUM) for p in
                        (FINAL_BASE_PREMIUM, CALCULATED_BASE_PREMIUM, BORROWED_EQUIPMENT_PREMIUM, MISC_TOOLS_PREMIUM)],
        "calculation_summary": [(EQUIPMENT_LIMIT, "decimal(18,0)", False)],
    }
    for path, dtype, split in extra.get(source, []):
        known.setdefault(path, (path, dtype, split))
    return list(known.values())


# Every quote has an older row that names no known job.
QUOTES = f"""
SELECT 'Q-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) || '-' || CAST(v.ver AS STRING) AS quote_id,
       CASE WHEN k.sk % 16 = 9 THEN NULL WHEN w.ver = 1 THEN 'J-none'
            ELSE 'J-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) || '-' || CAST(v.ver AS STRING) END AS job_id,
       'O-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) AS offer_id,
       TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(w.ver AS INT) AS creation_time,
       CASE WHEN k.sk % 19 = 5 THEN '{{bad' WHEN k.sk % 19 = 6 THEN NULL
            ELSE {_document(_paths("quote_package_data"))} END AS quote_package_data
FROM policy_keys k CROSS JOIN versions v CROSS JOIN versions w"""

RATING = f"""
SELECT 'J-' || CAST(k.sk AS STRING) || '-' || CAST(k.yr AS STRING) || '-' || CAST(w.ver AS STRING) AS job_id,
       CASE WHEN k.sk % 12 = 7 AND v.ver = 2 THEN 'GL' ELSE 'IM' END AS lob,
       CAST(k.yr * 10000 + 101 AS INT) AS dateid,
       TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(v.ver AS INT) AS update_time,
       CASE WHEN k.sk % 8 = 3 THEN NULL ELSE k.state END AS state,
       CASE WHEN k.sk % 17 = 5 THEN '{{bad' WHEN k.sk % 17 = 6 THEN NULL WHEN k.sk % 17 = 7 THEN ''
            ELSE {_document(_paths("calculation"))} END AS calculation,
       CASE WHEN k.sk % 18 = 5 THEN '{{bad'
            ELSE {_document(_paths("calculation_summary"))} END AS calculation_summary
FROM policy_keys k CROSS JOIN versions v CROSS JOIN versions w"""

# Name, text and the views it stands on, in order of need.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "terms": (TERMS, ()),
    "policy_keys": (POLICY_KEYS, ("terms",)),
    "versions": (VERSIONS, ()),
    "ages": (AGES, ()),
    "items": (ITEMS, ()),
    "periods": (PERIODS, ()),
    "claims_ledger": (LEDGER, ("terms", "policy_keys", "ages", "items")),
    "snapshots": (SNAPSHOTS, ("terms", "policy_keys")),
    "policies": (POLICIES, ("terms", "policy_keys")),
    "addresses": (ADDRESSES, ()),
    "rating": (RATING, ("terms", "policy_keys", "versions")),
    "quotes": (QUOTES, ("terms", "policy_keys", "versions")),
    "submissions": (SUBMISSIONS, ("terms", "policy_keys", "versions")),
    "policy_transactions": (POLICY_TRANSACTIONS, ("terms", "policy_keys", "versions")),
    "scores": (SCORES, ()),
    "third_party": (THIRD_PARTY, ()),
    "property_risk": (PROPERTY_RISK, ()),
    "company_metrics": (METRICS, ("terms", "policy_keys")),
}
LOGICAL = tuple(v for v in VIEWS if v not in ("terms", "policy_keys", "versions", "ages", "items"))


def view_chain(*names: str) -> list[tuple[str, str]]:
    """``(name, text)`` of the views and what they stand on, each once and in order."""
    needed = {n for name in names for n in (*VIEWS[name][1], name)}
    return [(n, VIEWS[n][0].strip()) for n in VIEWS if n in needed]


def with_views(names: tuple[str, ...], ctes: list[tuple[str, str]], final: str) -> str:
    """One checking statement: views, further steps, final select."""
    steps = [f"{n} AS (\n{text.strip()}\n)" for n, text in [*view_chain(*names), *ctes]]
    return "WITH " + ",\n".join(steps) + "\n" + final.strip()


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def spark_view(spark: SparkSession, sf_dir: str, name: str, written: dict[str, str] | None = None, tasks: int | None = None) -> DataFrame:
    """One view as a DataFrame over the Parquet files; views in ``written`` are read from their path, policies by ``tasks`` tasks."""
    written = written or {}
    chain = [(n, text) for n, text in view_chain(name) if n == name or n not in written]
    used = " ".join(text for _, text in chain)
    files = {t: f"{sf_dir}/{t}.parquet" for t in RAW} | written
    dealt = {"policy_keys": f"/*+ REPARTITION({tasks}) */ "} if tasks else {}
    raw = [(t, f"SELECT {dealt.get(t, '')}* FROM parquet.`{path}`") for t, path in files.items() if t != name and _mentions(used, t)]
    steps = [f"{n} AS (\n{text}\n)" for n, text in [*raw, *chain]]
    return spark.sql("WITH " + ",\n".join(steps) + f"\nSELECT * FROM {name}")


#: Policies whose documents one task lays out.
POLICIES_PER_TASK = 2_000
DOCUMENTS = ("rating", "quotes")
_BOOKS: dict[tuple[str, str], DerivedBook] = {}


class DerivedBook(Book):
    """The thirteen tables; each is made by ``derive`` when it is first asked for."""

    def __init__(self, derive: Callable[[str], DataFrame] | None = None, **tables: DataFrame):
        vars(self).update(tables, _derive=derive)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in LOGICAL:
            raise AttributeError(name)
        return vars(self).setdefault(name, vars(self)["_derive"](name))


def deriver(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Derives a table and writes it where every executor can read it.

    Documents are many times as long as the policy they are laid out for, so policies are dealt out, as many to a task at
    every size, and not the documents.  The other tables are written by the tasks that read the given ones.
    """
    root = f"{shared_folder(spark)}/book-{uuid.uuid4().hex}"
    written: dict[str, str] = {}

    def write(name: str, tasks: int | None = None) -> None:
        view = spark_view(spark, sf_dir, name, written, tasks)
        write_mart(conform(view, name) if name in LOGICAL else view, f"{root}/{name}")
        written[name] = f"{root}/{name}"

    def derive(name: str) -> DataFrame:
        tasks = None
        if "policy_keys" in VIEWS[name][1]:
            if "policy_keys" not in written:
                write("policy_keys")
            if name in DOCUMENTS:
                policies = spark.read.parquet(written["policy_keys"]).count()
                tasks = max(spark.sparkContext.defaultParallelism, -(-policies // POLICIES_PER_TASK))
        write(name, tasks)
        return conform(spark.read.parquet(written[name]), name)

    return derive


def load_book(spark: SparkSession, sf_dir: str) -> DerivedBook:
    """The thirteen tables, one book per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOOKS:
        _BOOKS[key] = DerivedBook(deriver(spark, sf_dir))
    return _BOOKS[key]
