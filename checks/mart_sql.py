"""The marts in plain DuckDB SQL, written the direct way: windows, distinct counts, joins on raw rows.

None of the rewrites of the Spark plans are used here, so agreement checks them.
"""

from __future__ import annotations

from collections.abc import Iterable

from checks.views import CONFIG, LOGICAL, with_views
from harborbook.config import (
    EARNED_TRANS,
    INCEPTION_TRANS,
    NON_CAT_CODES_CLAIMS,
    NON_CAT_CODES_POLICY,
    TRIMMED_TPA,
    WRITTEN_TRANS,
)
from harborbook.functions import JsonField
from harborbook.operators.crime import CRIMES
from harborbook.operators.losses import (
    ADDITIONAL_COVERAGES,
    ADDITIONAL_TOOLS_SPELLING,
    BLANKET_SPELLING,
    COVERAGE_FAMILIES,
    FIRE_CAUSES,
    OPTIONAL_COVERAGES,
    OPTIONAL_TOOLS_SPELLING,
    THEFT_CAUSES,
)
from harborbook.plans import attributes as A
from harborbook.plans import catalogue as K
from harborbook.plans import claim_development as C
from harborbook.plans import coverage_detail as M
from harborbook.plans import policy_monitoring as P
from harborbook.plans import rate_change as X
from harborbook.plans import rating_master as R


def quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def asc(columns: Iterable[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c} ASC NULLS LAST" for c in columns)


def period(date: str) -> str:
    return f"CAST(year({date}) * 100 + month({date}) AS INTEGER)"


def at(doc: str, path: tuple[str, ...]) -> str:
    keys = "".join(f'."{k}"' for k in path)
    return f"CASE WHEN json_valid({doc}) THEN json_extract_string({doc}, '${keys}') END"


def text_of(f: JsonField, doc: str) -> str:
    """Text of a field; a sub-document is read by a path call of its own."""
    found = at(at(doc, f.outer), f.rest) if f.inner else at(doc, f.path)
    return f"nullif(split_part({found}, '|', 1), '')" if f.split else f"nullif({found}, '')"


def number(text: str, dtype: str = "decimal(18,0)", default: str | None = None, split: bool = False) -> str:
    text = f"split_part({text}, '|', 1)" if split else text
    value = f"try_cast(nullif({text}, '') AS {dtype})"
    return value if default is None else f"CAST(coalesce({value}, {default}) AS {dtype})"


def field(f: JsonField, alias: dict[str, str]) -> str:
    return f"{number(at(f'{alias[f.source]}.{f.source}', f.path), f.dtype, f.default, f.split)} AS {f.name}"


def guarded(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '^[0-9.]+$') THEN try_cast({text} AS DECIMAL(18,0)) END"


LOB = f"lob = '{CONFIG.lob}'"
BOOK = f"{LOB} AND carrier_name IN ({quoted(CONFIG.carriers)})"
ALL = quoted(EARNED_TRANS + WRITTEN_TRANS)


def months(through: object) -> tuple[str, str]:
    return "months", f"""
SELECT DISTINCT {period("monthlastday")} AS eval_date, monthlastday AS eval_date_full
FROM periods WHERE date >= DATE '{CONFIG.start}' AND date <= DATE '{through}'"""


TX = ("tx", f"""
SELECT * FROM snapshots
WHERE {BOOK} AND trans IN ({ALL}) AND date <= (SELECT max(eval_date_full) FROM months)""")

BIND = ("bind", f"""
SELECT * FROM policy_transactions WHERE transaction_type = 'BIND' AND {LOB}
QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY tx_effective_date DESC, policy_transaction_id DESC) = 1""")
QUOTE = ("quote", """
SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY creation_time DESC) = 1""")
RATED = ("rated", f"""
SELECT * FROM rating WHERE {LOB}
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY dateid DESC, update_time DESC) = 1""")
ADDRESS = ("address", """
SELECT * FROM addresses QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY creation_time DESC) = 1""")
CREDIT = ("credit", """
SELECT business_id, score AS credit_score FROM scores WHERE score IS NOT NULL
QUALIFY rank() OVER (PARTITION BY business_id ORDER BY creation_time DESC) = 1""")


def _crime_source(doc: str, street: str, zip_code: str, table: str, where: str) -> str:
    def text(*path: str) -> str:
        return f"CASE WHEN json_valid({doc}) THEN coalesce({at(doc, path)}, '') END"

    scores = ", ".join(
        f"try_cast(nullif({text('Ms3', 'Crime', c, 'IndexValuesUpto10', 'Current')}, '') AS INTEGER) AS {c}" for c in CRIMES
    )
    street = text("Address", "StreetAddress1") if street == "doc" else street
    zip_code = text("Address", "Zip") if zip_code == "doc" else zip_code
    return f"""
SELECT {scores}, lower({street}) AS street, right('00000' || {zip_code}, 5) AS zip_code_5digit, creation_time
FROM {table} WHERE {where} AND json_valid({doc})"""


CRIME = ("crime", f"""
SELECT * FROM (
{_crime_source("response_data", "doc", "doc", "third_party", f"provider = '{CONFIG.crime_provider}'")}
UNION
{_crime_source("verisk_json_response", "street", "zip_code", "property_risk", "true")}
)
QUALIFY row_number() OVER (PARTITION BY street, zip_code_5digit ORDER BY creation_time DESC, {asc(CRIMES)}) = 1""")

PRIOR = ("prior", f"""
SELECT p.business_id, l.policy_reference, CASE WHEN sum(l.paid) > 0 THEN 'Y' ELSE 'N' END AS prior_loss_hist
FROM (SELECT policy_reference, coalesce(loss_paid_total, 0) AS paid FROM claims_ledger WHERE {LOB}
      QUALIFY row_number() OVER (PARTITION BY policy_reference, claim_id, exposure_id
                                 ORDER BY date DESC, coalesce(loss_paid_total, 0)) = 1) l
JOIN policies p ON p.policy_reference = l.policy_reference
GROUP BY ALL""")

ON_ADDRESS = "lower(addr.street_address) = vt.street AND right('00000' || addr.zip_code, 5) = vt.zip_code_5digit"

# Attributes of the policy and claim marts, one row per policy reference.
PICKED = ("picked", f"""
SELECT s.policy_id, s.policy_reference, s.business_id, CAST(s.start_date AS DATE) AS eff_date, CAST(s.end_date AS DATE) AS exp_date,
       {period("s.start_date")} AS eff_period, s.state, s.county, s.status_name, s.new_renewal, s.cob_name, s.cob_group,
       s.cob_industry, s.carrier_name, s.channel, s.affiliate_name, b.business_ownership_structure,
       b.revenue_next_12_months AS revenue_in_12_months, b.num_of_owners,
       CAST(year(s.start_date) - b.year_business_started AS INTEGER) AS years_in_bus, pr.prior_loss_hist,
       {guarded(at("r.calculation_summary", K.EQUIPMENT_LIMIT))} AS blanket_equip_occ_lim,
       m.distribution_channel_attributed AS distribution_channel, m.agency_aggregator AS agency_aggregator_name,
       m.agency_type AS current_agencytype, m.package AS highest_status_package, m.policy_status_name AS highest_status_name,
       h.yearly_premium, h.tria, h.surcharges, cr.credit_score, {", ".join(f"vt.{c}" for c in CRIMES)},
       sub.num_of_employees, {guarded(at("sub.questionnaire_answers", K.SUBCONTRACTOR_COST))} AS subcont_costs,
       b.package_name,
       CAST(date_diff('day', CAST(h.bind_date AS DATE), CAST(s.start_date AS DATE)) AS INTEGER) AS days_between_bind_to_policy_start
FROM tx s
LEFT JOIN bind b ON b.policy_id = s.policy_id
LEFT JOIN quote q ON q.quote_id = b.last_quote_id
LEFT JOIN submissions sub ON sub.first_offer_id = q.offer_id
LEFT JOIN rated r ON r.job_id = q.job_id
LEFT JOIN prior pr ON pr.policy_reference = s.policy_reference
LEFT JOIN company_metrics m ON m.policy_reference = s.policy_reference
LEFT JOIN policies h ON h.policy_id = s.policy_id
LEFT JOIN credit cr ON cr.business_id = s.business_id
LEFT JOIN address addr ON addr.business_id = s.business_id
LEFT JOIN crime vt ON {ON_ADDRESS}""")
ATTRS = ("attrs", f"""
SELECT * FROM picked
QUALIFY row_number() OVER (PARTITION BY policy_reference
  ORDER BY eff_date DESC, status_name ASC NULLS LAST, {asc(A.SNAPSHOT_ATTRIBUTES)}, {asc(A.LOOKUP_TIES)}) = 1""")
ATTRIBUTE_STEPS = [TX, BIND, QUOTE, RATED, ADDRESS, CREDIT, CRIME, PRIOR, PICKED, ATTRS]


# --- losses -------------------------------------------------------------------------------------


def add(*columns: str) -> str:
    return "(" + " + ".join(f"coalesce(a.{c}, 0)" for c in columns) + ")"


PAID = add(
    "loss_paid_total",
    "recovery_salvage_collected_total",
    "recovery_subrogation_collected_total",
    "expense_ao_paid_total",
    "expense_dcc_paid_total",
)
RESERVE3 = add("loss_reserve_total", "expense_ao_reserve_total", "expense_dcc_reserve_total")
RESERVE5 = f"({RESERVE3} + {add('recovery_salvage_reserve_total', 'recovery_subrogation_reserve_total')})"
INCURRED = f"({PAID} + {RESERVE3})"


def trimmed(column: str) -> str:
    return f"CASE WHEN a.tpa_name = '{TRIMMED_TPA}' THEN substring(a.{column}, 1, 13) ELSE a.{column} END AS {column}"


def status(reserve: str, by: str, month: str) -> str:
    return f"CASE WHEN sum({reserve}) OVER (PARTITION BY a.{by}, {month}) > 0 THEN 'Open' ELSE 'closed' END"


def cat(codes: Iterable[str], extra: str = "false") -> str:
    return (
        f"CASE WHEN a.catastrophe_code IS NULL OR a.catastrophe_code = '' OR a.catastrophe_code IN ({quoted(codes)}) OR {extra} "
        "THEN 'non-CAT' ELSE 'CAT' END AS cat_ind"
    )


def bit(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


POLICY_DATES = f"""CAST(a.policy_start_date AS DATE) AS eff_date, CAST(a.policy_end_date AS DATE) AS exp_date, a.date_of_loss AS acc_date,
       a.date_submitted AS rpt_date, {period("a.policy_start_date")} AS eff_period, {period("a.policy_end_date")} AS exp_period,
       {period("a.date_of_loss")} AS acc_period, {period("a.date")} AS eval_date"""
LEDGER_ROWS = f"""FROM claims_ledger a LEFT JOIN policies c ON c.policy_reference = a.policy_reference
WHERE a.{LOB} AND a.carrier_name IN ({quoted(CONFIG.carriers)}) AND a.date IN (SELECT eval_date_full FROM months)"""
COMMON = f"""{trimmed("claim_number")}, {trimmed("claim_id")}, a.exposure_number, a.exposure_id, a.policy_reference, c.policy_id,
       {POLICY_DATES},
       {status(RESERVE5, "claim_id", period("a.date"))} AS claim_status,
       {status(RESERVE5, "exposure_id", period("a.date"))} AS exposure_status,
       a.loss_cause_type_name, a.marketing_cob_group, a.cob_name, a.location_of_loss, a.business_state,
       {cat(NON_CAT_CODES_POLICY)}, {PAID} AS paid, {INCURRED} AS incurred"""


def counted(groups: Iterable[str]) -> str:
    """Counts of a claim; claims and exposures by distinct aggregates."""
    out = []
    for suffix, cats in (("", "true"), ("_non_cat", "cat_ind = 'non-CAT'")):
        for kind, claim, exposure in (
            ("", "true", "true"),
            ("_paid", "paid > 0", "paid > 0"),
            ("_closed", "claim_status = 'closed'", "exposure_status = 'closed'"),
            ("_closed_0paid", "paid = 0 AND claim_status = 'closed'", "paid = 0 AND exposure_status = 'closed'"),
        ):
            out.append(f"count(DISTINCT claim_number) FILTER (WHERE {cats} AND {claim}) AS count_claim{kind}{suffix}")
            rows = "count(exposure_number)" if not kind and not suffix else f"count(*) FILTER (WHERE {cats} AND {exposure})"
            out.append(f"{rows} AS exp_cnt{kind}{suffix}")
    for g in groups:
        out.append(f"count(DISTINCT claim_id) FILTER (WHERE {g} = 1) AS claim_cnt_{g}")
        out.append(f"count(DISTINCT exposure_id) FILTER (WHERE {g} = 1) AS exp_cnt_{g}")
    return ",\n       ".join(out)


def rollup(name: str, keys: Iterable[str], amounts: dict[str, str], groups: dict[str, str]) -> tuple[str, str]:
    sums = ", ".join(f"sum({c}) AS {n}" for n, c in amounts.items())
    splits = ", ".join(f"coalesce(sum(incurred) FILTER (WHERE {g} = 1), 0) AS {n}" for g, n in groups.items())
    non_cat = "CASE WHEN cat_ind = 'CAT' THEN 0 ELSE sum(incurred) END AS incurred_cum_non_cat"
    return name, f"""
SELECT {", ".join(keys)}, {sums}, {non_cat}, {splits},
       {counted(groups)}
FROM exposures GROUP BY {", ".join(keys)}"""


def premium_steps(key: str) -> list[tuple[str, str]]:
    def flow(kinds: Iterable[str], name: str) -> str:
        return (
            f"sum(CASE WHEN {period('t.date')} = f.eval_date AND t.trans IN ({quoted(kinds)}) "
            f"THEN t.dollar_amount ELSE 0 END) AS {name}"
        )

    frame = f"SELECT DISTINCT t.{key}, m.eval_date, m.eval_date_full FROM tx t CROSS JOIN months m"
    monthly = f"""
SELECT f.{key}, f.eval_date, f.eval_date_full, {flow(EARNED_TRANS, "ep")}, {flow(WRITTEN_TRANS, "wp")}
FROM frame f JOIN tx t ON t.{key} = f.{key} GROUP BY ALL"""
    over = f"OVER (PARTITION BY {key} ORDER BY eval_date ROWS UNBOUNDED PRECEDING)"
    premium = f"""
SELECT {key}, eval_date, eval_date_full, CAST(sum(ep) {over} AS DECIMAL(38,2)) AS ep_cum,
       CAST(sum(wp) {over} AS DECIMAL(38,2)) AS wp_cum
FROM monthly"""
    return [("frame", frame), ("monthly", monthly), ("premium", premium)]


def change(column: str, window: str, dtype: str, name: str) -> str:
    return f"CAST(coalesce({column} - lag({column}) OVER {window}, {column}) AS {dtype}) AS {name}"


def share_of_year(days: str, dtype: str = "DECIMAL(10,6)") -> str:
    return f"CAST({days} / CAST(365 AS DECIMAL(10,6)) AS {dtype})"


TERM_DAYS = "date_diff('day', a.eff_date, a.exp_date)"
AGE_DAYS = "date_diff('day', a.eff_date, a.eval_date_full)"
EARNED = f"CASE WHEN {AGE_DAYS} > {TERM_DAYS} THEN {share_of_year(TERM_DAYS)} ELSE {share_of_year(AGE_DAYS)} END AS ee_cum_py"


# --- policy monitoring ----------------------------------------------------------------------------

_cov_addl = (
    f"a.coverage IN ({quoted(ADDITIONAL_COVERAGES)}) OR (a.business_state <> 'CA' AND a.coverage = '{ADDITIONAL_TOOLS_SPELLING}')"
)
_cov_opt = (
    f"a.coverage IN ({quoted(OPTIONAL_COVERAGES)}) OR (a.business_state = 'CA' AND a.coverage = '{OPTIONAL_TOOLS_SPELLING}')"
)
P_EXPOSURES = ("exposures", f"""
SELECT DISTINCT {COMMON},
       CASE WHEN a.coverage IN ('BLANKET_EQUIPMENT', 'BLANKET_MISC') THEN 'BLANKET_EQUIPMENT' ELSE a.coverage END AS coverage,
       {add("loss_paid_total", "loss_reserve_total")} AS incurred_loss_only,
       {add("expense_dcc_paid_total", "expense_dcc_reserve_total")} AS incurred_dcc,
       {add("expense_ao_paid_total", "expense_ao_reserve_total")} AS incurred_ao,
       {add("recovery_subrogation_collected_total", "recovery_salvage_collected_total")} AS incurred_ss,
       {bit(f"a.loss_cause_type_name IN ({quoted(FIRE_CAUSES)})", "peril_fire")},
       {bit(f"a.loss_cause_type_name IN ({quoted(THEFT_CAUSES)})", "peril_theft")},
       {bit("a.loss_cause_type_name LIKE 'EQUIPMENT_BREAKDOWN%'", "peril_eqbd")},
       {bit(f"a.coverage = '{BLANKET_SPELLING}'", "cov_blanket")},
       {bit(_cov_addl, "cov_addl")}, {bit(_cov_opt, "cov_opt")}
{LEDGER_ROWS}""")


def policy_monitoring_sql() -> str:
    measures = [m for m in P.LOSSES]
    by_policy = ", ".join(f"sum({m}) AS {m}" for m in measures)
    columns = [
        "a.*",
        "1 AS policy_count",
        EARNED,
        f"{share_of_year(TERM_DAYS)} AS we_cum_py",
        *[f"CAST(c.{m} AS DECIMAL(15,2)) AS {m}" for m in measures],
    ]
    attributes = ", ".join(
        f"coalesce(t.{c}, d.{c}) AS {c}" if c in ("eff_date", "exp_date")
        else f"CASE WHEN t.policy_reference IS NOT NULL THEN coalesce(nullif(t.{c}, ''), 'Construction') END AS {c}" if c == "cob_industry"
        else f"t.{c}"
        for c in P.ATTRIBUTES
    )
    steps = [
        months(CONFIG.through),
        *ATTRIBUTE_STEPS,
        *premium_steps("policy_reference"),
        P_EXPOSURES,
        rollup("claims", P.CLAIM_KEYS, P.AMOUNTS, P.GROUPS),
        ("losses", f"SELECT policy_reference, eval_date, {by_policy} FROM claims GROUP BY ALL"),
        ("loss_dates", "SELECT policy_reference, min(eff_date) AS eff_date, min(exp_date) AS exp_date FROM exposures GROUP BY ALL"),
        ("active", "SELECT policy_reference, eval_date FROM premium UNION SELECT policy_reference, eval_date FROM losses"),
        ("combined", f"""
SELECT f.policy_reference, f.eval_date, coalesce(p.eval_date_full, m.eval_date_full) AS eval_date_full, {attributes}, p.ep_cum, p.wp_cum
FROM active f
LEFT JOIN attrs t ON t.policy_reference = f.policy_reference
LEFT JOIN premium p ON p.policy_reference = f.policy_reference AND p.eval_date = f.eval_date
LEFT JOIN months m ON m.eval_date = f.eval_date
LEFT JOIN loss_dates d ON d.policy_reference = f.policy_reference"""),
        ("exposed", f"""
SELECT {", ".join(columns)} FROM combined a
LEFT JOIN losses c ON c.policy_reference = a.policy_reference AND c.eval_date = a.eval_date"""),
    ]
    changes = [
        change("policy_count", "w", "INTEGER", "policy_count_inc"),
        change("ep_cum", "w", "DECIMAL(18,6)", "ep_inc"),
        change("wp_cum", "w", "DECIMAL(18,6)", "wp_inc"),
        change("ee_cum_py", "w", "DECIMAL(10,6)", "ee_cum_py_inc"),
        *[change(m, "w", "DECIMAL(15,2)", f"{m}_inc") for m in measures],
    ]
    final = f"SELECT *, {', '.join(changes)} FROM exposed WINDOW w AS (PARTITION BY policy_reference ORDER BY eval_date)"
    return with_views(LOGICAL, steps, final)


# --- claim development ----------------------------------------------------------------------------


HARMLESS = "lower(a.catastrophe_code) LIKE '%subro%' OR lower(a.catastrophe_code) LIKE '%salv%'"
CLAIM_EXPOSURE_STEPS = [
    ("exposures", f"""
SELECT DISTINCT m.eval_date, m.eval_date_full, a.business_id, a.policy_reference, c.policy_id, a.tpa_name,
       {trimmed("claim_number")}, {trimmed("claim_id")}, a.exposure_number, a.exposure_id,
       CAST(a.policy_start_date AS DATE) AS eff_date, CAST(a.policy_end_date AS DATE) AS exp_date, a.date_of_loss AS acc_date,
       min(a.date_submitted) OVER (PARTITION BY a.claim_id) AS rpt_date,
       {period("a.policy_start_date")} AS eff_period, {period("a.date_of_loss")} AS acc_period,
       CAST(date_trunc('month', m.eval_date_full) AS DATE) AS eval_date_trunc,
       {PAID} AS paid, {INCURRED} AS incurred, {add("loss_paid_total", "loss_reserve_total")} AS incurred_loss_only,
       {add("expense_dcc_paid_total", "expense_dcc_reserve_total")} AS incurred_dcc,
       {add("expense_ao_paid_total", "expense_ao_reserve_total")} AS incurred_ao,
       {add("recovery_subrogation_collected_total", "recovery_salvage_collected_total")} AS incurred_ss,
       {status(RESERVE3, "claim_id", "m.eval_date_full")} AS claim_status,
       {status(RESERVE3, "exposure_id", "m.eval_date_full")} AS exposure_status,
       CAST(sum({PAID}) OVER (PARTITION BY a.claim_id, m.eval_date_full) AS DECIMAL(28,2)) AS claim_lvl_eval_paid,
       {cat(NON_CAT_CODES_CLAIMS, HARMLESS)}, a.coverage, a.loss_cause_type_name, a.marketing_cob_group AS cob_group, a.cob_name,
       a.business_state AS state, a.in_suit_flag, a.attorney_authorized_representative_flag, a.location_of_loss
FROM claims_ledger a JOIN months m ON m.eval_date_full = a.date LEFT JOIN policies c ON c.policy_reference = a.policy_reference
WHERE a.{LOB} AND a.carrier_name IN ({quoted(CONFIG.carriers)})"""),
    ("lagged", f"""
SELECT *, CAST(date_diff('day', acc_date, rpt_date) AS INTEGER) AS rpt_lag,
       CAST(CASE WHEN date_diff('day', acc_date, rpt_date) > 50 THEN 50 ELSE date_diff('day', acc_date, rpt_date) END AS INTEGER)
         AS rpt_lag_capped
FROM exposures"""),
]


def claim_counts(source: str = "lagged") -> str:
    """Every column of the exposures with amounts outside catastrophes, counts and claim shares."""
    n_exposure = "count(exposure_id) OVER (PARTITION BY exposure_id, eval_date)"
    n_claim = "count(exposure_id) OVER (PARTITION BY claim_id, eval_date)"

    def exposures_if(condition: str) -> str:
        return f"CASE WHEN {condition} THEN {n_exposure} ELSE 0 END"

    def share_if(condition: str) -> str:
        return f"CAST(coalesce(1.0 / nullif(CASE WHEN {condition} THEN {n_claim} ELSE 0 END, 0), 0) AS DECIMAL(15,6))"

    conditions = {
        "": ("true", "true"),
        "_paid": ("paid > 0", "claim_lvl_eval_paid > 0"),
        "_closed": ("exposure_status = 'closed'", "claim_status = 'closed'"),
        "_closed_0paid": ("paid = 0 AND exposure_status = 'closed'", "claim_status = 'closed' AND claim_lvl_eval_paid = 0"),
        "_non_cat": ("cat_ind = 'non-CAT'", "cat_ind = 'non-CAT'"),
    }
    counts = ", ".join(
        f"{exposures_if(e)} AS exp_cnt{k}, {share_if(c)} AS count_claim{k}" for k, (e, c) in conditions.items()
    )
    return f"""
SELECT DISTINCT *, CASE WHEN cat_ind = 'CAT' THEN 0 ELSE incurred END AS incurred_non_cat,
       CASE WHEN cat_ind = 'CAT' THEN 0 ELSE paid END AS paid_non_cat, {counts}
FROM {source}"""


def claim_development_sql() -> str:
    attributes = ", ".join(f"t.{c}" for c in C.ATTRIBUTES)
    money = [c for c in C.CUMULATIVE if c not in C.COUNTS]
    amounts = [*[c for c in money], "paid_non_cat"]
    typed = ", ".join(f"CAST({c} AS DECIMAL(18,2)) AS {c}" for c in amounts)
    changes = [change(c, "w", "DECIMAL(15,2)", f"{c}_inc") for c in money]
    changes += [
        change(c, "w", "DECIMAL(15,6)" if c.startswith("count_claim") else "BIGINT", f"{c}_inc") for c in C.COUNTS
    ]
    ties = ", ".join(f"{c} ASC NULLS FIRST" for c in C.ROW_TIES)
    steps = [
        months(CONFIG.through),
        *ATTRIBUTE_STEPS,
        *CLAIM_EXPOSURE_STEPS,
        ("attached", f"SELECT a.*, {attributes} FROM lagged a LEFT JOIN attrs t ON t.policy_reference = a.policy_reference WHERE a.eval_date >= a.eff_period"),
        ("summary", claim_counts("attached")),
    ]
    final = f"""
SELECT * REPLACE ({typed}), {", ".join(changes)}
FROM summary WINDOW w AS (PARTITION BY exposure_id ORDER BY eval_date, {ties})"""
    return with_views(LOGICAL, steps, final)


# --- coverage detail ------------------------------------------------------------------------------


_families = ", ".join(bit(f"a.coverage IN ({quoted(codes)})", family) for family, codes in COVERAGE_FAMILIES.items())
M_EXPOSURES = ("exposures", f"""
SELECT DISTINCT {COMMON}, a.coverage,
       CASE WHEN try_cast(a.accident_zip_code AS INTEGER) = 0 OR a.accident_zip_code = '' THEN 'n.a.'
            ELSE right('00000' || a.accident_zip_code, 5) END AS acc_zip_code, {_families}
{LEDGER_ROWS} AND a.date_of_loss >= DATE '{CONFIG.start}'""")


def coverage_detail_sql() -> str:
    alias = {"calculation": "r", "calculation_summary": "r"}
    fields = {f.name: f for f in K.COVERAGE_FIELDS}
    numbers = ", ".join(field(f, alias) for f in fields.values())
    optional = fields["optional_coverage_premium"]
    optional_sql = number(at("r.calculation_summary", optional.path), optional.dtype, optional.default)
    borrowed = number(at("r.calculation", K.BORROWED_EQUIPMENT_PREMIUM))
    misc = number(at("r.calculation", K.MISC_TOOLS_PREMIUM), default="0")
    variants = f"""
SELECT DISTINCT s.policy_id, s.policy_reference, s.business_id, CAST(s.start_date AS DATE) AS eff_date,
       CAST(s.end_date AS DATE) AS exp_date, {period("s.start_date")} AS eff_period, s.state, s.county, s.new_renewal, s.cob_name,
       s.cob_group, coalesce(nullif(s.cob_industry, ''), 'Construction') AS cob_industry, s.carrier_name, s.channel,
       m.distribution_channel_attributed AS distribution_channel, m.agency_aggregator AS agency_aggregator_name,
       m.agency_type AS current_agencytype, b.business_ownership_structure, m.package AS highest_status_package,
       m.policy_status_name AS highest_status_name, h.yearly_premium, h.tria, h.surcharges, {numbers},
       CASE WHEN r.state <> 'CA' THEN {optional_sql} WHEN r.state = 'CA' THEN {borrowed} ELSE 0 END AS borrowed_equip_premium,
       CASE WHEN r.state = 'CA' THEN {misc} ELSE 0 END AS misc_tools_prem
FROM tx s
LEFT JOIN policies h ON h.policy_id = s.policy_id
LEFT JOIN bind b ON b.policy_id = s.policy_id
LEFT JOIN quote q ON q.quote_id = b.last_quote_id
LEFT JOIN rated r ON r.job_id = q.job_id
LEFT JOIN company_metrics m ON m.policy_reference = s.policy_reference
WHERE s.end_date > s.start_date"""
    by_grain = ", ".join(f"sum({m}) AS {m}" for m in M.LOSSES)
    steps = [
        months(CONFIG.through),
        TX,
        BIND,
        QUOTE,
        RATED,
        *premium_steps("policy_id"),
        M_EXPOSURES,
        rollup("claims", M.CLAIM_KEYS, M.AMOUNTS, M.GROUPS),
        ("losses", f"SELECT policy_reference, {', '.join(M.LOSS_GRAIN)}, eval_date, {by_grain} FROM claims GROUP BY ALL"),
        ("variants", variants),
        ("sizes", "SELECT policy_id, count(policy_id) AS n FROM variants GROUP BY ALL"),
        ("chosen", "SELECT DISTINCT v.* FROM variants v LEFT JOIN sizes z ON z.policy_id = v.policy_id WHERE z.n = 1"),
        ("grid", """
SELECT v.*, p.eval_date, p.eval_date_full, p.ep_cum, p.wp_cum
FROM chosen v FULL JOIN premium p ON p.policy_id = v.policy_id WHERE v.exp_date > v.eff_date"""),
    ]
    columns = [f"a.{c}" for c in (*M.POLICY_COLUMNS, "eval_date", "eval_date_full", "ep_cum", "wp_cum")]
    order = ", ".join(f"b.{c} ASC NULLS FIRST" for c in M.LOSS_GRAIN)
    lag = f"lag(1) OVER (PARTITION BY a.policy_id ORDER BY a.eval_date, {order})"
    final = f"""
SELECT {", ".join(columns)}, {EARNED}, {share_of_year(TERM_DAYS, "DECIMAL(15,2)")} AS we_cum_py, 1 AS policy_count,
       CAST(coalesce(1 - {lag}, 1) AS INTEGER) AS policy_count_inc, {", ".join(f"b.{c}" for c in M.LOSS_GRAIN)},
       {", ".join(f"CAST(b.{m} AS DECIMAL(15,2)) AS {m}" for m in M.LOSSES)}
FROM grid a LEFT JOIN losses b ON b.policy_reference = a.policy_reference AND b.eval_date = a.eval_date
WHERE a.ep_cum > 0"""
    return with_views(LOGICAL, steps, final)


# --- rate change ----------------------------------------------------------------------------------


def rate_change_sql() -> str:
    alias = {"calculation": "r"}
    factors = ", ".join(field(f, alias) for f in K.RATE_CHANGE_FIELDS)
    priced = f"""
SELECT DISTINCT s.business_id, s.policy_id, s.policy_reference, CAST(s.start_date AS DATE) AS eff_date,
       CAST(s.end_date AS DATE) AS exp_date, i.customer_inception, s.new_renewal, s.carrier_name, s.state, s.cob_name, s.cob_group,
       coalesce(nullif(s.cob_industry, ''), 'Construction') AS cob_industry, s.channel, m.policy_status_name AS highest_status_name,
       CAST(date_diff('day', i.customer_inception, CAST(s.start_date AS DATE)) // 365 AS INTEGER) AS policy_term,
       {guarded(at("r.calculation_summary", K.EQUIPMENT_LIMIT))} AS exposure, {factors}, h.yearly_premium AS sold_premium
FROM tx s
JOIN policies h ON h.policy_id = s.policy_id
LEFT JOIN inception i ON i.business_id = s.business_id
LEFT JOIN bind b ON b.policy_id = s.policy_id
LEFT JOIN quote q ON q.quote_id = b.last_quote_id
LEFT JOIN rated r ON r.job_id = q.job_id
LEFT JOIN company_metrics m ON m.policy_reference = s.policy_reference
WHERE s.end_date > s.start_date"""
    base = "CASE WHEN exposure < 10000 THEN exposure * 0.01 * base_premium_loss_cost ELSE 100 * base_premium_loss_cost END"
    above = "CASE WHEN exposure > 10000 THEN (exposure - 10000) * 0.01 * loss_cost_10K ELSE 0 END"
    rerated = f"""
SELECT *, CAST({base} + {above} AS DECIMAL(18,4)) AS pure_premium_total,
       CAST(CAST({base} + {above} AS DECIMAL(18,4)) * ded_factor * base_premium_lcm AS DECIMAL(28,8)) AS manual_premium,
       CAST(CAST(CAST({base} + {above} AS DECIMAL(18,4)) * ded_factor * base_premium_lcm AS DECIMAL(28,8)) * blanket_factor
            AS DECIMAL(33,10)) AS modified_premium
FROM priced"""
    ranked = "SELECT *, rank() OVER (PARTITION BY business_id, policy_term ORDER BY eff_date DESC) AS from_last FROM rerated"
    steps = [
        months(CONFIG.through),
        TX,
        BIND,
        QUOTE,
        RATED,
        ("inception", """
SELECT business_id, CAST(min(start_date) AS DATE) AS customer_inception FROM tx WHERE end_date > start_date GROUP BY ALL"""),
        ("priced", priced),
        ("rerated", rerated),
        ("ranked", ranked),
    ]
    columns = [f"a.{c}" for c in X.CURRENT] + [f"b.{c} AS {n}" for c, n in X.CARRIED.items()]
    final = f"""
SELECT DISTINCT {", ".join(columns)} FROM ranked a
LEFT JOIN (SELECT DISTINCT * FROM ranked WHERE from_last = 1) b
  ON b.business_id = a.business_id AND b.policy_term = a.policy_term - 1"""
    return with_views(LOGICAL, steps, final)


# --- rating master --------------------------------------------------------------------------------


LIFETIME = ("lifetime", f"""
SELECT policy_reference, sum(incurred) AS incurred_loss, sum(paid) AS paid_loss,
       count(DISTINCT claim_id) AS claim_count, count(DISTINCT claim_id) FILTER (WHERE paid > 0) AS non_zero_claim_count
FROM (SELECT a.policy_reference, a.claim_id, {PAID} AS paid, {INCURRED} AS incurred FROM claims_ledger a WHERE a.{LOB}
      QUALIFY row_number() OVER (PARTITION BY a.claim_id
        ORDER BY a.date DESC, {asc(["exposure_id", "policy_reference"], "a.")}, {PAID}, {INCURRED}) = 1)
GROUP BY ALL""")


def rating_master_sql() -> str:
    alias = {"calculation": "r", "quote_package_data": "q"}
    numbers = ", ".join(field(f, alias) for f in K.RATING_MASTER_FIELDS)
    final_text = at("r.calculation", K.FINAL_BASE_PREMIUM)
    base_text = at("r.calculation", K.CALCULATED_BASE_PREMIUM)
    base_premium = f"""CASE WHEN nullif({final_text}, '') IS NULL THEN {number(base_text, split=True)}
            ELSE {number(final_text, default="0")} END"""
    wide = f"""
SELECT s.policy_reference, s.policy_id, s.business_id, s.new_renewal, h.yearly_premium, CAST(h.bind_date AS DATE) AS purch_date,
       CAST(s.start_date AS DATE) AS eff_date, CAST(s.end_date AS DATE) AS exp_date, {period("s.start_date")} AS eff_period,
       addr.county, addr.zip_code, s.state, b.package_name AS highest_status_package, m.policy_status_name AS highest_status_name,
       s.cob_name, s.cob_group, coalesce(nullif(s.cob_industry, ''), 'Construction') AS cob_industry, s.carrier_name AS carrier,
       s.carrier_name, s.channel, {numbers}, {base_premium} AS base_premium, h.tria AS tria_premium,
       CASE WHEN h.tria > 0 THEN 'Y' ELSE 'N' END AS tria_ind, cr.credit_score,
       {", ".join(f"vt.{c} AS crime_score_{c.lower()}" for c in CRIMES)},
       CAST(coalesce(l.incurred_loss, 0) AS DECIMAL(28,2)) AS incurred_loss, CAST(coalesce(l.paid_loss, 0) AS DECIMAL(28,2)) AS paid_loss,
       coalesce(l.claim_count, 0) AS claim_count, coalesce(l.non_zero_claim_count, 0) AS non_zero_claim_count
FROM snapshots s
LEFT JOIN policies h ON h.policy_id = s.policy_id
LEFT JOIN company_metrics m ON m.policy_reference = s.policy_reference
LEFT JOIN address addr ON addr.business_id = s.business_id
LEFT JOIN bind b ON b.policy_id = s.policy_id
LEFT JOIN quote q ON q.quote_id = b.last_quote_id
LEFT JOIN rated r ON r.job_id = q.job_id
LEFT JOIN credit cr ON cr.business_id = s.business_id
LEFT JOIN crime vt ON {ON_ADDRESS}
LEFT JOIN lifetime l ON l.policy_reference = s.policy_reference
WHERE s.{LOB} AND s.carrier_name IN ({quoted(CONFIG.carriers)}) AND s.trans IN ({quoted(INCEPTION_TRANS)})
  AND s.date <= (SELECT max(eval_date_full) FROM months) AND s.end_date > s.start_date"""
    crimes = [f"crime_score_{c.lower()}" for c in CRIMES]
    ties = asc([*R.SNAPSHOT_TIES, *[t for t in R.LOOKUP_TIES if t not in CRIMES], *crimes])
    steps = [months(CONFIG.rating_through), BIND, QUOTE, RATED, ADDRESS, CREDIT, CRIME, LIFETIME, ("wide", wide)]
    final = f"""
SELECT {", ".join(R.COLUMNS)} FROM wide
QUALIFY row_number() OVER (PARTITION BY policy_reference ORDER BY eff_date DESC, {ties}) = 1"""
    return with_views(LOGICAL, steps, final)
