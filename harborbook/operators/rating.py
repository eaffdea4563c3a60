"""Policy terms, tiered premium and prior-term pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborbook.functions import as_col, blank_to_null, days_between, decimal_field, nz
from harborbook.operators.keys import top_rank_per_key
from harborbook.operators.skew import Hot, salted_join

TIER_LIMIT = 10_000


def customer_inception(snapshots: DataFrame) -> DataFrame:
    """First policy start per business."""
    return snapshots.groupBy("business_id").agg(F.min("start_date").cast("date").alias("customer_inception"))


def policy_term(inception: Column | str, start: Column | str) -> Column:
    """Whole 365-day years since the customer's first start."""
    return F.call_function("div", days_between(inception, start), F.lit(365)).cast("int")


def rate_premium(
    limit: Column | str,
    loss_cost: Column | str,
    loss_cost_10k: Column | str,
    ded_factor: Column | str,
    lcm: Column | str,
    blanket_factor: Column | str,
) -> dict[str, Column]:
    """Premium from the equipment limit: one rate per 100 up to 10,000, another above.

    A NULL limit is rated like 10,000.  Decimals are wide enough to be exact at every step.
    """
    limit = as_col(limit)
    per_100 = F.lit("0.01").cast("decimal(2,2)")
    at_tier = F.lit(TIER_LIMIT // 100) * as_col(loss_cost)
    base = F.when(limit < TIER_LIMIT, limit * per_100 * as_col(loss_cost)).otherwise(at_tier)
    above = F.when(limit > TIER_LIMIT, (limit - TIER_LIMIT) * per_100 * as_col(loss_cost_10k)).otherwise(F.lit(0))
    base, above = base.cast("decimal(18,4)"), above.cast("decimal(18,4)")
    pure = (base + above).cast("decimal(18,4)")
    manual = (pure * as_col(ded_factor) * as_col(lcm)).cast("decimal(28,8)")
    return {
        "pure_premium_base": base,
        "pure_premium_ilf": above,
        "pure_premium": pure,
        "manual_premium": manual,
        "modified_premium": (manual * as_col(blanket_factor)).cast("decimal(33,10)"),
    }


def prior_term_pairs(
    policies: DataFrame, carried: dict[str, str], keep: Sequence[str], hot: Hot | None = None
) -> DataFrame:
    """Each policy beside the policies of its business one term earlier that started last in that term.

    ``carried`` maps a column of the earlier policy to its name in the result.  Policies that started on
    the same last day all pair up; without a policy one term earlier the carried columns are NULL.
    ``keep`` contains ``business_id`` and ``policy_term``; ``hot`` holds the hot values of ``business_id``.
    """
    earlier = _last_of_term_before(policies, carried)
    current = policies.select(*keep).distinct()
    term = ["business_id", "policy_term"]
    paired = salted_join(current, earlier.distinct(), term, "left", hot=hot, hot_on=["business_id"])
    return paired.select(*keep, *carried.values()).distinct()


def prior_term_classes(policies: DataFrame, carried: dict[str, str], keep: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """What ``prior_term_pairs`` lists, counted and added up per business and term, without listing it.

    All policies of a term meet the same earlier ones, so these are two classes, and n and m policies make n * m pairs.
    Gives (business_id, policy_term, n_policies, n_earlier, n_pairs, sums), one row per class of current policies; a
    policy without an earlier one is one pair.  ``sums`` names columns of ``keep`` and new names of ``carried``; each is
    added up over all pairs, NULL where every value is.  Policies without a business or term have a class and no earlier one.
    """
    term = ["business_id", "policy_term"]
    own = [c for c in sums if c in keep]
    unknown = set(sums) - set(own) - set(carried.values())
    if unknown:
        raise ValueError(f"neither kept nor carried: {', '.join(sorted(unknown))}")
    current = policies.select(*keep).distinct().groupBy(*term)
    current = current.agg(F.count(F.lit(1)).alias("n_policies"), *[F.sum(c).alias(c) for c in own])
    earlier = _last_of_term_before(policies, carried).distinct().groupBy(*term)
    earlier = earlier.agg(F.count(F.lit(1)).alias("n_earlier"), *[F.sum(c).alias(c) for c in sums if c not in own])
    met = current.join(earlier, term, "left").withColumn("n_earlier", nz("n_earlier"))
    times = F.greatest("n_earlier", F.lit(1).cast("bigint"))

    def over_pairs(c: str) -> Column:
        return (F.col(c) * (times if c in own else F.col("n_policies")).cast("decimal(20,0)")).alias(c)

    return met.select(*term, "n_policies", "n_earlier", (F.col("n_policies") * times).alias("n_pairs"), *map(over_pairs, sums))


def _last_of_term_before(policies: DataFrame, carried: dict[str, str]) -> DataFrame:
    """The carried columns of the policies that started last in a term, under the term after it."""
    last_of_term = top_rank_per_key(policies, ["business_id", "policy_term"], "eff_date")
    return last_of_term.where(F.col("business_id").isNotNull()).select(
        "business_id", (F.col("policy_term") + 1).alias("policy_term"), *[F.col(c).alias(n) for c, n in carried.items()]
    )


def base_premium_fallback(final_text: Column | str, base_text: Column | str, strict: bool = False) -> Column:
    """The final base premium where one is given, else the first part of the base calculation."""
    from_base = decimal_field(base_text, "decimal(18,0)", split=True, strict=strict)
    from_final = decimal_field(final_text, "decimal(18,0)", default="0", strict=strict)
    return F.when(blank_to_null(final_text).isNull(), from_base).otherwise(from_final)


def state_switch_premium(state: Column | str, california: Column, elsewhere: Column) -> Column:
    """One premium in California, another in every other state, 0 where the state is unknown."""
    state = as_col(state)
    return F.when(state != "CA", elsewhere).when(state == "CA", california).otherwise(F.lit(0))


def tria_indicator(tria: Column | str) -> Column:
    return F.when(as_col(tria) > 0, F.lit("Y")).otherwise(F.lit("N"))
