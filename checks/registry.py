"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from checks import mart_sql as Q
from checks.operator_queries import QUERIES, Query
from checks.views import CONFIG, load_book
from harborbook.plans.claim_development import claim_development
from harborbook.plans.coverage_detail import coverage_detail
from harborbook.plans.policy_monitoring import policy_monitoring
from harborbook.plans.rate_change import rate_change
from harborbook.plans.rating_master import rating_master

MARTS = {
    "rating_master": (rating_master, Q.rating_master_sql),
    "claim_development": (claim_development, Q.claim_development_sql),
    "policy_monitoring": (policy_monitoring, Q.policy_monitoring_sql),
    "coverage_detail": (coverage_detail, Q.coverage_detail_sql),
    "rate_change": (rate_change, Q.rate_change_sql),
}


def _mart(build) -> Query:
    return lambda spark, sf_dir: build(load_book(spark, sf_dir), CONFIG)


def all_queries() -> dict[str, Query]:
    return {name: _mart(build) for name, (build, _) in MARTS.items()} | {n: f for n, (f, _) in QUERIES.items()}


def all_sql() -> dict[str, str]:
    marts = {name: sql() for name, (_, sql) in MARTS.items()}
    return marts | {n: sql for n, (_, sql) in QUERIES.items() if sql is not None}
