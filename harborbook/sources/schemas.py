"""Columns the marts read, per logical table."""

from __future__ import annotations

AMOUNT = "decimal(18,2)"

SCHEMAS: dict[str, str] = {
    "periods": "date date, monthlastday date",
    "claims_ledger": f"""
        date date, claim_id string, claim_number string, exposure_id string, exposure_number string,
        policy_reference string, business_id string, lob string, carrier_name string, tpa_name string,
        policy_start_date timestamp, policy_end_date timestamp, date_of_loss date, date_submitted date,
        loss_paid_total {AMOUNT}, expense_ao_paid_total {AMOUNT}, expense_dcc_paid_total {AMOUNT},
        recovery_salvage_collected_total {AMOUNT}, recovery_subrogation_collected_total {AMOUNT},
        loss_reserve_total {AMOUNT}, expense_ao_reserve_total {AMOUNT}, expense_dcc_reserve_total {AMOUNT},
        recovery_salvage_reserve_total {AMOUNT}, recovery_subrogation_reserve_total {AMOUNT},
        catastrophe_code string, coverage string, loss_cause_type_name string, marketing_cob_group string,
        cob_name string, business_state string, location_of_loss string, in_suit_flag string,
        attorney_authorized_representative_flag string, accident_zip_code string""",
    "snapshots": f"""
        date date, policy_id string, policy_reference string, business_id string, lob string,
        carrier_name string, trans string, dollar_amount {AMOUNT}, start_date timestamp, end_date timestamp,
        state string, county string, status_name string, new_renewal string, cob_name string,
        cob_group string, cob_industry string, channel string, affiliate_name string""",
    "policies": f"""
        policy_id string, policy_reference string, business_id string, yearly_premium {AMOUNT},
        tria {AMOUNT}, surcharges {AMOUNT}, bind_date timestamp""",
    "addresses": "business_id string, street_address string, zip_code string, county string, creation_time timestamp",
    "rating": """
        job_id string, lob string, dateid int, update_time timestamp, state string, calculation string,
        calculation_summary string""",
    "quotes": "quote_id string, job_id string, offer_id string, creation_time timestamp, quote_package_data string",
    "submissions": "first_offer_id string, num_of_employees int, questionnaire_answers string",
    "policy_transactions": f"""
        policy_id string, policy_transaction_id string, tx_effective_date date, transaction_type string,
        lob string, last_quote_id string, package_name string, business_ownership_structure string,
        num_of_owners int, revenue_next_12_months {AMOUNT}, year_business_started int""",
    "scores": "business_id string, score int, creation_time timestamp",
    "third_party": "provider string, response_data string, creation_time timestamp",
    "property_risk": "verisk_json_response string, street string, zip_code string, creation_time timestamp",
    "company_metrics": """
        policy_reference string, policy_status_name string, package string,
        distribution_channel_attributed string, agency_aggregator string, agency_type string""",
}
