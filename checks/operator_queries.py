"""One query per operator, each beside plain SQL that must give the same rows.

Operators are run over the whole of the given tables, or over the insurance tables derived from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import mart_sql as Q
from checks.views import CONFIG, LOGICAL, load_book, shared_folder, with_views
from harborbook.config import (
    EARNED_TRANS,
    NON_CAT_CODES_CLAIMS,
    NON_CAT_CODES_POLICY,
    NON_CAT_FRAGMENTS_CLAIMS,
    TRIMMED_LENGTH,
    WRITTEN_TRANS,
)
from harborbook.functions import (
    JsonField,
    blank_to_null,
    capped,
    days_between,
    decimal_field,
    first_part,
    flag,
    guarded_number,
    json_fields,
    json_text,
    nz,
    text_like_zero,
    yyyymm,
    zip5,
)
from harborbook.functions.jsonfields import json_paths, json_problems
from harborbook.operators.calendars import at_month_ends, month_spine, up_to_last_month
from harborbook.operators.crime import CRIMES, crime_scores
from harborbook.operators.enrich import (
    activity_spine,
    book_rows,
    business_profile,
    company_metrics,
    latest_address,
    latest_scores,
)
from harborbook.operators.flows import (
    change,
    earned_exposure,
    increments,
    increments_of_rows,
    monthly_amounts,
    monthly_flow,
    pack_months,
    running_total,
    written_exposure,
)
from harborbook.operators.homes import HOME
from harborbook.operators.keys import keep_singletons, latest_per_key, top_rank_per_key
from harborbook.operators.losses import (
    RESERVES,
    cat_flag,
    coverage_flags,
    family_flags,
    fractional_counts,
    in_units,
    lifetime_losses,
    loss_measures,
    non_cat,
    open_closed_status,
    peril_flags,
    prior_loss_flag,
    report_lag,
    rollup_amounts,
    rollup_measures,
    tpa_id_trim,
)
from harborbook.operators.ranges import previous_values, running_total_of_rows
from harborbook.operators.rating import (
    base_premium_fallback,
    customer_inception,
    policy_term,
    prior_term_classes,
    prior_term_pairs,
    rate_premium,
    state_switch_premium,
    tria_indicator,
)
from harborbook.operators.skew import attach_totals, find_hot_keys, salted_join
from harborbook.plans import catalogue as K
from harborbook.plans import claim_development as C
from harborbook.plans import coverage_detail as M
from harborbook.plans import policy_monitoring as P
from harborbook.plans.attributes import ALL_TRANS, bound_documents, policy_attributes
from harborbook.plans.exposures import book_ledger, hot_in_ledger
from harborbook.sources import write_mart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
MONEY = "decimal(18,2)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
    )


def order_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = orders_by_day(spark, sf_dir).select(F.col("day").alias("date"), F.last_day("day").alias("monthlastday"))
    return month_spine(days, CONFIG.start, CONFIG.through)


ORDER_STEPS = [
    ("days", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount
FROM orders"""),
    ("months", f"""
SELECT DISTINCT {Q.period("day")} AS eval_date, last_day(day) AS eval_date_full
FROM days WHERE day >= DATE '{CONFIG.start}' AND day <= DATE '{CONFIG.through}'"""),
]


def over_orders(final: str, *steps: tuple[str, str]) -> str:
    return with_views((), [*ORDER_STEPS, *steps], final)


def over_book(final: str, *steps: tuple[str, str]) -> str:
    return with_views(LOGICAL, list(steps), final)


# --- calendar, keys, windows -------------------------------------------------------------------


@query(over_orders("SELECT * FROM months"))
def month_spine_of_orders(spark, sf_dir):
    return order_spine(spark, sf_dir)


@query(over_orders("""
SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) = 1"""))
def latest_order_per_customer(spark, sf_dir):
    return latest_per_key(orders_by_day(spark, sf_dir), "o_custkey", "day", ["o_orderkey"])


@query(over_orders("""
SELECT * FROM days
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY day DESC, amount DESC, o_orderkey) = 1"""))
def latest_order_by_two_sort_keys(spark, sf_dir):
    return latest_per_key(orders_by_day(spark, sf_dir), ["o_custkey", "o_orderstatus"], ["day", "amount"], ["o_orderkey"])


@query(over_orders("SELECT * FROM days QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY day DESC) = 1"))
def orders_tied_on_last_day(spark, sf_dir):
    return top_rank_per_key(orders_by_day(spark, sf_dir), "o_custkey", "day")


@query("""
SELECT l_orderkey, any_value(l_returnflag) AS l_returnflag, any_value(l_linestatus) AS l_linestatus
FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY l_orderkey HAVING count(*) = 1""")
def orders_with_one_kind_of_line(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return keep_singletons(lines, "l_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
       sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey) AS order_quantity,
       count(l_partkey) OVER (PARTITION BY l_orderkey) AS order_lines,
       min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey) AS first_ship
FROM lineitem""")
def order_totals_on_every_line(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_shipdate").cast("date").alias("_ship"),
    )
    totals = {"order_quantity": F.sum("quantity"), "order_lines": F.count("l_partkey"), "first_ship": F.min("_ship")}
    out = attach_totals(rows, "l_orderkey", totals).drop("_ship")
    return out.withColumn("order_quantity", F.col("order_quantity").cast("decimal(38,2)"))


@query(over_orders("""
SELECT *, CAST(sum(total) OVER (PARTITION BY o_custkey ORDER BY eval_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS so_far
FROM (SELECT o_custkey, CAST(year(day) * 100 + month(day) AS INTEGER) AS eval_date, CAST(sum(amount) AS DECIMAL(28,2)) AS total
      FROM days GROUP BY ALL)"""))
def running_total_per_customer(spark, sf_dir):
    monthly = monthly_amounts(orders_by_day(spark, sf_dir), "o_custkey", "day", {"total": F.col("amount")})
    return running_total(monthly, "o_custkey", "eval_date", {"total": "so_far"}).withColumn(
        "so_far", F.col("so_far").cast("decimal(38,2)")
    )


_FRAME = ("frame", "SELECT * FROM (SELECT DISTINCT o_custkey FROM days) CROSS JOIN months")
_FLOW = ("flow", """
SELECT f.o_custkey, f.eval_date, f.eval_date_full, coalesce(sum(d.amount), 0) AS spent
FROM frame f LEFT JOIN days d ON d.o_custkey = f.o_custkey AND last_day(d.day) = f.eval_date_full
GROUP BY ALL""")


def customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = orders_by_day(spark, sf_dir)
    flow = monthly_flow(days, "o_custkey", "day", {"spent": F.col("amount")}, order_spine(spark, sf_dir))
    return flow.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("spent", "spent_cum")})


@query(over_orders("""
SELECT o_custkey, eval_date, eval_date_full, CAST(spent AS DECIMAL(28,2)) AS spent,
       CAST(sum(spent) OVER (PARTITION BY o_custkey ORDER BY eval_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS spent_cum
FROM flow""", _FRAME, _FLOW))
def monthly_flow_per_customer(spark, sf_dir):
    return customer_months(spark, sf_dir)


@query(over_orders("""
SELECT *, CAST(coalesce(spent_cum - lag(spent_cum) OVER w, spent_cum) AS DECIMAL(15,2)) AS spent_inc
FROM (SELECT o_custkey, eval_date, eval_date_full, CAST(spent AS DECIMAL(28,2)) AS spent,
             CAST(sum(spent) OVER (PARTITION BY o_custkey ORDER BY eval_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS spent_cum
      FROM flow)
WINDOW w AS (PARTITION BY o_custkey ORDER BY eval_date)""", _FRAME, _FLOW))
def customer_month_increments(spark, sf_dir):
    return increments(
        customer_months(spark, sf_dir), "o_custkey", "eval_date", {"spent_cum": "spent_inc"}, {"spent_cum": "decimal(15,2)"}
    )


@query(over_orders("""
SELECT o_custkey, o_orderkey, CAST(year(day) * 100 + month(day) AS INTEGER) AS eval_date, amount,
       CAST(coalesce(amount - lag(amount) OVER (PARTITION BY o_custkey ORDER BY year(day) * 100 + month(day), o_orderkey), amount)
            AS DECIMAL(15,2)) AS amount_inc
FROM days"""))
def order_to_order_increments(spark, sf_dir):
    days = orders_by_day(spark, sf_dir).select("o_custkey", "o_orderkey", yyyymm("day").alias("eval_date"), "amount")
    return increments_of_rows(days, "o_custkey", "eval_date", ["o_orderkey"], {"amount": "amount_inc"}, {"amount": "decimal(15,2)"})


#: Half of all lines, those of even orders, belong to one key and one month.
HOT_LINES = """
SELECT CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_suppkey END AS supplier,
       CAST(CASE WHEN l_orderkey % 2 = 0 THEN 199501 ELSE year(l_shipdate) * 100 + month(l_shipdate) END AS INTEGER) AS eval_date,
       l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS DECIMAL(15,2)) AS amount
FROM lineitem"""
HOT_ORDER = ["eval_date", "l_orderkey", "l_linenumber", "amount"]


def hot_lines(spark, sf_dir):
    even = F.col("l_orderkey") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.when(~even, F.col("l_suppkey")).alias("supplier"),
        F.when(even, F.lit(199501)).otherwise(yyyymm("l_shipdate")).alias("eval_date"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).cast("decimal(15,2)").alias("amount"),
    )


@query(f"""
SELECT *, CAST(coalesce(amount - lag(amount) OVER w, amount) AS DECIMAL(16,2)) AS amount_inc
FROM ({HOT_LINES})
WINDOW w AS (PARTITION BY supplier ORDER BY eval_date, l_orderkey, l_linenumber, amount NULLS FIRST)""")
def line_increments_with_a_hot_key(spark, sf_dir):
    rows = previous_values(hot_lines(spark, sf_dir), "supplier", HOT_ORDER, ["amount"])
    inc = change(F.col("amount"), F.col("_prior")["amount"]).cast("decimal(16,2)").alias("amount_inc")
    return rows.select("supplier", *HOT_ORDER, inc)


@query(f"""
SELECT *, CAST(sum(amount) OVER w AS DECIMAL(25,2)) AS amount_cum
FROM ({HOT_LINES})
WINDOW w AS (PARTITION BY supplier ORDER BY eval_date, l_orderkey, l_linenumber, amount NULLS FIRST ROWS UNBOUNDED PRECEDING)""")
def line_running_total_with_a_hot_key(spark, sf_dir):
    out = running_total_of_rows(hot_lines(spark, sf_dir), "supplier", HOT_ORDER, {"amount": "amount_cum"})
    return out.withColumn("amount_cum", F.col("amount_cum").cast("decimal(25,2)"))


@query(f"""
SELECT *, CAST(sum(amount) OVER w AS DECIMAL(25,2)) AS month_amount, count(*) OVER w AS month_lines,
       min(l_orderkey) OVER (PARTITION BY supplier) AS first_order
FROM ({HOT_LINES})
WINDOW w AS (PARTITION BY supplier, eval_date)""")
def line_totals_with_a_hot_key(spark, sf_dir):
    lines = hot_lines(spark, sf_dir)
    hot = find_hot_keys(lines, {"supplier": ["supplier"]})["supplier"]
    totals = {"month_amount": F.sum("amount"), "month_lines": F.count(F.lit(1))}
    out = attach_totals(lines, ["supplier", "eval_date"], totals, hot, ["supplier"])
    out = attach_totals(out, "supplier", {"first_order": F.min("l_orderkey")}, hot, of=lines)
    return out.withColumn("month_amount", F.col("month_amount").cast("decimal(25,2)"))


@query(f"""
SELECT l.*, s_name FROM ({HOT_LINES}) l
LEFT JOIN (SELECT nullif(s_suppkey, 1) AS s_suppkey, s_name FROM supplier) ON s_suppkey IS NOT DISTINCT FROM supplier""")
def lines_with_supplier_and_a_hot_key(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.nullif("s_suppkey", F.lit(1)).alias("supplier"), "s_name")
    return salted_join(hot_lines(spark, sf_dir), suppliers, "supplier", null_safe=True)


# --- filters, joins, sets, sources ------------------------------------------------------------


@query(over_orders("SELECT d.* FROM days d WHERE d.day IN (SELECT eval_date_full FROM months)"))
def orders_on_month_ends(spark, sf_dir):
    return at_month_ends(orders_by_day(spark, sf_dir), order_spine(spark, sf_dir), "day")


@query(over_orders("SELECT * FROM days WHERE day <= (SELECT max(eval_date_full) FROM months)"))
def orders_up_to_last_month(spark, sf_dir):
    return up_to_last_month(orders_by_day(spark, sf_dir), order_spine(spark, sf_dir), "day")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""")
def lines_with_their_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return salted_join(lines, orders, "l_orderkey", "left")


@query("""
SELECT c_nationkey AS nationkey, c_mktsegment AS label FROM customer
UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier""")
def union_of_nations_served(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("label"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("SUPPLIER").alias("label"))
    return customers.unionByName(suppliers).distinct()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders")
def orders_written_and_read_back(spark, sf_dir):
    days = orders_by_day(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "day")
    path = f"{shared_folder(spark)}/orders-by-status-{uuid.uuid4().hex}"
    write_mart(days, path, ["o_orderstatus"], ["o_custkey"])
    return spark.read.parquet(path).select(days.columns)


FILE_ROWS = 500


@query("""
SELECT o_orderstatus, count(*) AS orders, CAST(0 AS BIGINT) AS overlapping_files, CAST(0 AS BIGINT) AS files_too_large
FROM orders GROUP BY o_orderstatus""")
def orders_in_bounded_files(spark, sf_dir):
    """Files of orders per status: rows, files that begin before the one before them ends, files above the bound."""
    path = f"{shared_folder(spark)}/orders-in-files-{uuid.uuid4().hex}"
    days = orders_by_day(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "day")
    write_mart(days, path, ["o_orderstatus"], ["o_custkey"], rows_per_file=FILE_ROWS)
    rows = spark.read.parquet(path).select("o_orderstatus", "o_custkey", F.col("_metadata.file_path").alias("file"))
    files = rows.groupBy("o_orderstatus", "file").agg(
        F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.count(F.lit(1)).alias("n")
    )
    in_order = Window.partitionBy("o_orderstatus").orderBy("low", "high")
    files = files.withColumn("before", F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    return files.groupBy("o_orderstatus").agg(
        F.sum("n").alias("orders"),
        F.count_if(F.col("before") > F.col("low")).alias("overlapping_files"),
        F.count_if(F.col("n") > FILE_ROWS).alias("files_too_large"),
    )


@query(over_book(f"SELECT policy_id, policy_reference, date, trans, dollar_amount FROM tx WHERE end_date > start_date",
                 Q.months(CONFIG.through), Q.TX))
def book_transactions(spark, sf_dir):
    book = load_book(spark, sf_dir)
    spine = month_spine(book.periods, CONFIG.start, CONFIG.through)
    rows = book_rows(book.snapshots, spine, CONFIG, ALL_TRANS, positive_term=True)
    return rows.select("policy_id", "policy_reference", "date", "trans", "dollar_amount")


# --- scalar functions --------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS period,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days,
       CAST(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 50 THEN 50
            ELSE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS INTEGER) AS days_capped,
       last_day(CAST(l_shipdate - INTERVAL '1' MONTH AS DATE)) AS last_month_end,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
       CAST(year(l_shipdate) - 1980 AS INTEGER) AS years_since,
       CASE WHEN lower(l_returnflag) = 'r' THEN 1 ELSE 0 END AS returned
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def dates_of_lines(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ship = F.col("l_shipdate").cast("date")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        yyyymm(ship).alias("period"),
        days_between("o_orderdate", "l_shipdate").alias("days"),
        capped(days_between("o_orderdate", "l_shipdate"), 50).alias("days_capped"),
        F.last_day(F.add_months(ship, -1)).alias("last_month_end"),
        F.trunc(ship, "month").alias("month_start"),
        (F.year(ship) - 1980).alias("years_since"),
        flag(F.lower("l_returnflag") == "r").alias("returned"),
    )


@query("""
SELECT c_custkey, right('00000' || CAST(c_custkey AS VARCHAR), 5) AS zip, substring(c_name, 1, 13) AS short_name,
       split_part(c_name, '#', 1) AS prefix, nullif(split_part(c_name, '#', 3), '') AS nothing,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment,
       CASE WHEN try_cast(split_part(c_name, '#', 2) AS INTEGER) = 0 OR split_part(c_name, '#', 2) = '' THEN 1 ELSE 0 END AS is_zero,
       CAST(coalesce(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END, 0) AS DECIMAL(18,2)) AS credit
FROM customer""")
def texts_of_customers(spark, sf_dir):
    number = F.split_part("c_name", F.lit("#"), F.lit(2))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        zip5(F.col("c_custkey").cast("string")).alias("zip"),
        F.substring("c_name", 1, 13).alias("short_name"),
        first_part("c_name", "#").alias("prefix"),
        blank_to_null(F.split_part("c_name", F.lit("#"), F.lit(3))).alias("nothing"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"),
        flag(text_like_zero(number)).alias("is_zero"),
        nz(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast(MONEY))).cast(MONEY).alias("credit"),
    )


@query("""
SELECT s_suppkey, year(min_ship) AS first_year, lines, returned_quantity, open_lines, kinds
FROM (SELECT l_suppkey AS s_suppkey, min(l_shipdate) AS min_ship, count(l_partkey) AS lines,
             sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS returned_quantity,
             CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines,
             count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_returnflag END) AS kinds
      FROM lineitem GROUP BY l_suppkey)""".replace("year(min_ship)", "CAST(year(min_ship) AS INTEGER)"))
def conditional_totals_per_supplier(spark, sf_dir):
    open_line = F.col("l_linestatus") == "O"
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.year(F.min("l_shipdate")).alias("first_year"),
        F.count("l_partkey").alias("lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast(MONEY)).otherwise(0)).alias("returned_quantity"),
        F.sum(flag(open_line)).alias("open_lines"),
        F.countDistinct(F.when(open_line, F.col("l_returnflag"))).alias("kinds"),
    )
    return out.withColumn("returned_quantity", F.col("returned_quantity").cast("decimal(38,2)"))


# --- JSON --------------------------------------------------------------------------------------

_EVENT_FIELDS = (
    JsonField("k", "props", ("k",), "decimal(18,0)"),
    JsonField("k_or_7", "props", ("missing",), "decimal(10,4)", "7"),
)


@query("""
SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '') AS DECIMAL(18,0)) AS k, CAST(7 AS DECIMAL(10,4)) AS k_or_7,
       coalesce(json_extract_string(props, '$.missing'), '') AS missing_text, json_extract_string(props, '$.missing') AS missing_null
FROM events""")
def event_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "props",
        json_text("props", "missing").alias("missing_text"),
        json_text("props", "missing", missing="null").alias("missing_null"),
    )
    return json_fields(events, _EVENT_FIELDS).drop("props")


_A1 = [f for f in K.RATING_MASTER_FIELDS if f.source == "calculation"]
_A2 = [f for f in K.COVERAGE_FIELDS if f.source == "calculation_summary"]


@query(over_book(
    "SELECT r.job_id, r.lob, CAST(r.update_time AS VARCHAR) AS at, "
    + ", ".join(Q.field(f, {"calculation": "r"}) for f in _A1) + " FROM rating r"))
def rating_factors_of_every_document(spark, sf_dir):
    rating = load_book(spark, sf_dir).rating
    rows = rating.select("job_id", "lob", F.date_format("update_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "calculation")
    return json_fields(rows, _A1).drop("calculation")


# A sub-document is an object, the text of one, or no JSON, by the order; both engines read this SQL.
_SUB = """concat('{"limits": {"OCCURRENCE": "', CAST(l_partkey AS STRING), '", "DEDUCTIBLE": ', CASE WHEN l_linenumber = 3 THEN '"none"' ELSE CAST(l_linenumber AS STRING) END, '}}')"""
_DOCUMENT = f"""CASE WHEN l_orderkey % 7 = 6 THEN '{{bad' ELSE concat(
  '{{"coverages": {{"BASE": {{"subCoverages": {{"BLANKET_EQUIPMENT": ',
  CASE l_orderkey % 3 WHEN 0 THEN {_SUB} WHEN 1 THEN concat('"', replace({_SUB}, '"', concat(chr(92), '"')), '"') ELSE '"{{oops"' END,
  '}}}}}}}}') END AS quote_package_data"""
_NESTED = f"SELECT l_orderkey, l_linenumber, {_DOCUMENT} FROM lineitem"
_EQUIPMENT = [f for f in K.RATING_MASTER_FIELDS if f.path[:4] == ("coverages", "BASE", "subCoverages", "BLANKET_EQUIPMENT")]


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", _DOCUMENT)


@query(f"WITH d AS ({_NESTED}) SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"try_cast({Q.text_of(f, 'quote_package_data')} AS {f.dtype}) AS {f.name}" for f in _EQUIPMENT) + " FROM d")
def limits_in_nested_documents(spark, sf_dir):
    return json_fields(nested_documents(spark, sf_dir), _EQUIPMENT).drop("quote_package_data")


def _problems_sql(rows: str, keys: str, fields: Sequence[JsonField]) -> str:
    """Every problem by path calls of its own."""
    entries = []
    for f in fields:
        text = Q.text_of(f, f.source)
        entries.append((f.source, f"'{f.name}'", "number", text, f"{text} IS NOT NULL AND try_cast({text} AS {f.dtype}) IS NULL"))
    for source in {f.source: 0 for f in fields}:
        entries.append((source, "NULL", "document", source, f"nullif({source}, '') IS NOT NULL AND NOT json_valid({source})"))
    for (source, outer), name in {(f.source, f.outer): f.name for f in reversed(fields) if f.inner}.items():
        sub = Q.at(source, outer)
        entries.append((source, f"'{name}'", "sub-document", sub, f"nullif({sub}, '') IS NOT NULL AND NOT json_valid({sub})"))
    listed = ", ".join(
        f"CASE WHEN {wrong} THEN {{'source': '{s}', 'field': CAST({n} AS VARCHAR), 'problem': '{p}', 'found': {t}}} END" for s, n, p, t, wrong in entries
    )
    return f"""SELECT {keys}, p.source AS source, p.field AS field, p.problem AS problem, p.found AS found
FROM (SELECT {keys}, unnest([{listed}]) AS p FROM {rows}) WHERE p IS NOT NULL"""


@query(f"WITH d AS ({_NESTED}) " + _problems_sql("d", "l_orderkey, l_linenumber", _EQUIPMENT))
def problems_of_nested_documents(spark, sf_dir):
    return json_problems(nested_documents(spark, sf_dir), _EQUIPMENT, ["l_orderkey", "l_linenumber"])


@query(over_book(_problems_sql("rating", "job_id, dateid", _A2)))
def problems_of_rating_documents(spark, sf_dir):
    return json_problems(load_book(spark, sf_dir).rating, _A2, ["job_id", "dateid"])


@query(over_book(
    "SELECT r.job_id, r.lob, CAST(r.update_time AS VARCHAR) AS at, "
    + ", ".join(Q.field(f, {"calculation_summary": "r"}) for f in _A2) + " FROM rating r"))
def coverage_premiums_of_every_document(spark, sf_dir):
    rating = load_book(spark, sf_dir).rating
    rows = rating.select("job_id", "lob", F.date_format("update_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "calculation_summary")
    return json_fields(rows, _A2).drop("calculation_summary")


@query(over_book(f"""
SELECT first_offer_id, num_of_employees, {Q.guarded(Q.at("s.questionnaire_answers", K.SUBCONTRACTOR_COST))} AS cost
FROM submissions s"""))
def guarded_subcontractor_cost(spark, sf_dir):
    text = json_text("questionnaire_answers", *K.SUBCONTRACTOR_COST)
    rows = load_book(spark, sf_dir).submissions
    return rows.select("first_offer_id", "num_of_employees", guarded_number(text).alias("cost"))


@query(over_book(f"""
SELECT job_id, lob, CAST(update_time AS VARCHAR) AS at,
       CASE WHEN nullif({Q.at("r.calculation", K.FINAL_BASE_PREMIUM)}, '') IS NULL
            THEN {Q.number(Q.at("r.calculation", K.CALCULATED_BASE_PREMIUM), split=True)}
            ELSE {Q.number(Q.at("r.calculation", K.FINAL_BASE_PREMIUM), default="0")} END AS base_premium,
       CASE WHEN state <> 'CA' THEN CAST(1 AS DECIMAL(18,0))
            WHEN state = 'CA' THEN {Q.number(Q.at("r.calculation", K.BORROWED_EQUIPMENT_PREMIUM))} ELSE 0 END AS borrowed
FROM rating r"""))
def fallback_and_state_premiums(spark, sf_dir):
    rating = load_book(spark, sf_dir).rating
    paths = {"_f": K.FINAL_BASE_PREMIUM, "_c": K.CALCULATED_BASE_PREMIUM, "_b": K.BORROWED_EQUIPMENT_PREMIUM}
    one = F.lit(1).cast("decimal(18,0)")
    borrowed = state_switch_premium("state", decimal_field("_b", "decimal(18,0)"), one).cast("decimal(18,0)")
    return json_paths(rating, "calculation", paths).select(
        "job_id",
        "lob",
        F.date_format("update_time", "yyyy-MM-dd HH:mm:ss").alias("at"),
        base_premium_fallback("_f", "_c").alias("base_premium"),
        borrowed.alias("borrowed"),
    )


@query(over_book(f"SELECT {', '.join(CRIMES)}, street, zip_code_5digit FROM crime", Q.CRIME))
def newest_crime_scores(spark, sf_dir):
    book = load_book(spark, sf_dir)
    return crime_scores(book.third_party, book.property_risk, CONFIG.crime_provider).drop("creation_time")


# --- losses ------------------------------------------------------------------------------------

_ROW = "a.exposure_id, a.date"


@query(over_book(f"""
SELECT {_ROW}, {", ".join(f"CAST({sql} AS DECIMAL(18,2)) AS {name}" for name, sql in {
    "paid": Q.PAID,
    "incurred": Q.INCURRED,
    "incurred_loss_only": Q.add("loss_paid_total", "loss_reserve_total"),
    "incurred_dcc": Q.add("expense_dcc_paid_total", "expense_dcc_reserve_total"),
    "incurred_ao": Q.add("expense_ao_paid_total", "expense_ao_reserve_total"),
    "incurred_ss": Q.add("recovery_subrogation_collected_total", "recovery_salvage_collected_total"),
}.items())}
FROM claims_ledger a"""))
def loss_measures_of_the_ledger(spark, sf_dir):
    return load_book(spark, sf_dir).claims_ledger.select("exposure_id", "date", *named(loss_measures()))


_HARMLESS = "lower(a.catastrophe_code) LIKE '%subro%' OR lower(a.catastrophe_code) LIKE '%salv%'"


@query(over_book(f"""
SELECT {_ROW}, {Q.cat(NON_CAT_CODES_CLAIMS, _HARMLESS).replace(" AS cat_ind", " AS cat_claims")},
       {Q.cat(NON_CAT_CODES_POLICY).replace(" AS cat_ind", " AS cat_policy")},
       {Q.trimmed("claim_id")}, {Q.trimmed("claim_number")},
       CASE WHEN a.catastrophe_code = 'CAT-55' THEN 0 ELSE a.loss_paid_total END AS paid_non_cat,
       CAST(date_diff('day', a.date_of_loss, a.date_submitted) AS INTEGER) AS rpt_lag,
       CAST(CASE WHEN date_diff('day', a.date_of_loss, a.date_submitted) > 50 THEN 50
            ELSE date_diff('day', a.date_of_loss, a.date_submitted) END AS INTEGER) AS rpt_lag_capped
FROM claims_ledger a"""))
def claim_flags_ids_and_lags(spark, sf_dir):
    code = F.when(F.col("catastrophe_code") == "CAT-55", F.lit("CAT")).otherwise(F.lit("non-CAT"))
    ids = {c: tpa_id_trim(c, "tpa_name", CONFIG.trimmed_tpa, TRIMMED_LENGTH) for c in ("claim_id", "claim_number")}
    return load_book(spark, sf_dir).claims_ledger.select(
        "exposure_id",
        "date",
        cat_flag("catastrophe_code", NON_CAT_CODES_CLAIMS, NON_CAT_FRAGMENTS_CLAIMS).alias("cat_claims"),
        cat_flag("catastrophe_code", NON_CAT_CODES_POLICY).alias("cat_policy"),
        *named(ids),
        non_cat("loss_paid_total", code).cast(MONEY).alias("paid_non_cat"),
        report_lag("date_of_loss", "date_submitted").alias("rpt_lag"),
        report_lag("date_of_loss", "date_submitted", 50).alias("rpt_lag_capped"),
    )


_FLAGS = {
    "peril_fire": f"a.loss_cause_type_name IN ({Q.quoted(Q.FIRE_CAUSES)})",
    "peril_theft": f"a.loss_cause_type_name IN ({Q.quoted(Q.THEFT_CAUSES)})",
    "peril_eqbd": "a.loss_cause_type_name LIKE 'EQUIPMENT_BREAKDOWN%'",
    "cov_blanket": f"a.coverage = '{Q.BLANKET_SPELLING}'",
    "cov_addl": Q._cov_addl,
    "cov_opt": Q._cov_opt,
    **{f: f"a.coverage IN ({Q.quoted(codes)})" for f, codes in Q.COVERAGE_FAMILIES.items()},
}


@query(over_book(f"SELECT {_ROW}, {', '.join(Q.bit(c, n) for n, c in _FLAGS.items())} FROM claims_ledger a"))
def peril_and_coverage_flags(spark, sf_dir):
    ledger = load_book(spark, sf_dir).claims_ledger
    return ledger.select("exposure_id", "date", *named(peril_flags()), *named(coverage_flags()), *named(family_flags()))


@query(over_book(f"""
SELECT a.claim_id, a.exposure_id, a.date, {Q.status(Q.RESERVE3, "claim_id", "a.date")} AS claim_status,
       {Q.status(Q.RESERVE3, "exposure_id", "a.date")} AS exposure_status
FROM claims_ledger a"""))
def open_and_closed_claims(spark, sf_dir):
    ledger = load_book(spark, sf_dir).claims_ledger.withColumn("copies", F.lit(1))
    rows = open_closed_status(ledger, "date", RESERVES)
    return rows.select("claim_id", "exposure_id", "date", "claim_status", "exposure_status")


def _spine(book):
    return month_spine(book.periods, CONFIG.start, CONFIG.through)


def _typed_sums(measures: Sequence[str], counts: str = "BIGINT") -> str:
    return ", ".join(
        f"CAST({m} AS {'DECIMAL(38,2)' if 'incurred' in m or m == 'paid_cum' else counts}) AS {m}" for m in measures
    )


def _typed(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    kind = {m: "decimal(38,2)" if "incurred" in m or m == "paid_cum" else "bigint" for m in measures}
    return df.withColumns({m: F.col(m).cast(t) for m, t in kind.items()})


_P_MEASURES = rollup_measures(list(P.AMOUNTS), P.GROUPS)


@query(over_book(
    f"SELECT {', '.join(P.CLAIM_KEYS)}, {_typed_sums(_P_MEASURES)} FROM claims",
    Q.months(CONFIG.through), Q.P_EXPOSURES, Q.rollup("claims", P.CLAIM_KEYS, P.AMOUNTS, P.GROUPS)))
def claims_rolled_up(spark, sf_dir):
    book = load_book(spark, sf_dir)
    claims = in_units(P.claim_losses(book, CONFIG, _spine(book)), rollup_amounts(list(P.AMOUNTS), P.GROUPS))
    return _typed(claims, _P_MEASURES).select(*P.CLAIM_KEYS, *_P_MEASURES)


@query(over_book(
    f"""
SELECT policy_reference, eval_date, {_typed_sums(_P_MEASURES)}, eff_date, exp_date
FROM (SELECT policy_reference, eval_date, {", ".join(f"sum({m}) AS {m}" for m in _P_MEASURES)},
             min(eff_date) AS eff_date, min(exp_date) AS exp_date FROM claims GROUP BY ALL)""",
    Q.months(CONFIG.through), Q.P_EXPOSURES, Q.rollup("claims", P.CLAIM_KEYS, P.AMOUNTS, P.GROUPS)))
def policy_losses_by_month(spark, sf_dir):
    book = load_book(spark, sf_dir)
    return _typed(P.policy_losses(book, CONFIG, _spine(book)), _P_MEASURES)


@query(over_book(
    f"""
SELECT {", ".join(M.LOSS_GRAIN)}, policy_reference, eval_date, {_typed_sums(M.LOSSES)}
FROM (SELECT policy_reference, {", ".join(M.LOSS_GRAIN)}, eval_date, {", ".join(f"sum({m}) AS {m}" for m in M.LOSSES)}
      FROM claims GROUP BY ALL)""",
    Q.months(CONFIG.through), Q.M_EXPOSURES, Q.rollup("claims", M.CLAIM_KEYS, M.AMOUNTS, M.GROUPS)))
def losses_by_coverage_and_cause(spark, sf_dir):
    book = load_book(spark, sf_dir)
    losses = M.coverage_losses(book, CONFIG, _spine(book))
    return _typed(losses, M.LOSSES).select("policy_reference", "eval_date", *M.LOSS_GRAIN, *M.LOSSES)


@query(over_book(
    f"SELECT exposure_id, eval_date, policy_id, claim_id, {', '.join(C.COUNTS)} FROM ({Q.claim_counts()})",
    Q.months(CONFIG.through), *Q.CLAIM_EXPOSURE_STEPS))
def fractional_claim_counts(spark, sf_dir):
    book = load_book(spark, sf_dir)
    ledger = book_ledger(book.claims_ledger, _spine(book), CONFIG)
    hot = hot_in_ledger(ledger, CONFIG)
    at_homes, others = C.claim_exposures(book, CONFIG, ledger, hot)
    shown = ["exposure_id", "eval_date", "policy_id", "claim_id", *C.COUNTS]
    counts = fractional_counts(others, hot=hot | {"claim": hot["trimmed"]}).select(*shown)
    return fractional_counts(at_homes, home=HOME).select(*shown).unionByName(counts)


@query(over_book("SELECT * FROM prior", Q.PRIOR))
def prior_losses_per_policy(spark, sf_dir):
    book = load_book(spark, sf_dir)
    return prior_loss_flag(book.claims_ledger, book.policies, CONFIG.lob)


@query(over_book("""
SELECT policy_reference, CAST(incurred_loss AS DECIMAL(28,2)) AS incurred_loss, CAST(paid_loss AS DECIMAL(28,2)) AS paid_loss,
       claim_count, non_zero_claim_count FROM lifetime""", Q.LIFETIME))
def lifetime_losses_per_policy(spark, sf_dir):
    losses = lifetime_losses(load_book(spark, sf_dir).claims_ledger, CONFIG.lob)
    return losses.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("incurred_loss", "paid_loss")})


# --- exposure, premium, attributes --------------------------------------------------------------


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, a.eff_date, a.exp_date, a.eval_date_full, {Q.EARNED}, {Q.share_of_year(Q.TERM_DAYS)} AS we_cum_py,
       {Q.share_of_year(Q.TERM_DAYS, "DECIMAL(15,2)")} AS we_rounded
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS eff_date,
             CAST(o_orderdate + INTERVAL '1' YEAR AS DATE) AS exp_date, CAST(l_shipdate AS DATE) AS eval_date_full
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey) a""")
def exposure_of_order_years(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("o_orderdate").cast("date").alias("eff_date"),
        F.add_months(F.col("o_orderdate").cast("date"), 12).alias("exp_date"),
        F.col("l_shipdate").cast("date").alias("eval_date_full"),
    )
    return rows.select(
        "*",
        earned_exposure("eff_date", "exp_date", "eval_date_full").alias("ee_cum_py"),
        written_exposure("eff_date", "exp_date").alias("we_cum_py"),
        written_exposure("eff_date", "exp_date", "decimal(15,2)").alias("we_rounded"),
    )


def _premium(book, key: str) -> DataFrame:
    tx = book_rows(book.snapshots, _spine(book), CONFIG, ALL_TRANS)
    flows = {
        "ep": F.when(F.col("trans").isin(*EARNED_TRANS), F.col("dollar_amount")),
        "wp": F.when(F.col("trans").isin(*WRITTEN_TRANS), F.col("dollar_amount")),
    }
    return monthly_flow(tx, key, "date", flows, _spine(book))


@query(over_book("SELECT * FROM premium", Q.months(CONFIG.through), Q.TX, *Q.premium_steps("policy_reference")))
def premium_per_policy_month(spark, sf_dir):
    flow = _premium(load_book(spark, sf_dir), "policy_reference")
    return flow.select(
        "policy_reference",
        "eval_date",
        "eval_date_full",
        *[F.col(c).cast("decimal(38,2)").alias(c) for c in ("ep_cum", "wp_cum")],
    )


@query(over_book(
    "SELECT policy_reference, eval_date FROM premium UNION SELECT policy_reference, eval_date FROM claims",
    Q.months(CONFIG.through), Q.TX, *Q.premium_steps("policy_reference"),
    ("claims", f"SELECT DISTINCT a.policy_reference, {Q.period('a.date')} AS eval_date {Q.LEDGER_ROWS}")))
def months_with_premium_or_loss(spark, sf_dir):
    book = load_book(spark, sf_dir)
    spine = _spine(book)
    tx = book_rows(book.snapshots, spine, CONFIG, ALL_TRANS)
    monthly = monthly_amounts(tx, "policy_reference", "date", {"amount": F.col("dollar_amount")})
    premium = pack_months(monthly, "policy_reference", ["amount"], spine, "_flow").withColumn("_has", F.lit(True))
    losses = book_ledger(book.claims_ledger, spine, CONFIG).select("policy_reference", "eval_date").distinct()
    entry = F.struct("eval_date", F.lit(1))
    losses = losses.groupBy("policy_reference").agg(F.map_from_entries(F.collect_list(entry)).alias("_losses"))
    keyed = premium.join(losses, "policy_reference", "full").withColumn("_has", F.coalesce("_has", F.lit(False)))
    return activity_spine(keyed, spine, "_has", "_losses").select("policy_reference", "eval_date")


@query(over_book(f"""
SELECT addr.business_id, addr.county AS address_county, addr.zip_code, cr.credit_score, {", ".join(f"vt.{c}" for c in CRIMES)}
FROM address addr FULL JOIN (SELECT DISTINCT * FROM credit) cr ON cr.business_id = addr.business_id LEFT JOIN crime vt ON {Q.ON_ADDRESS}""",
                 Q.ADDRESS, Q.CREDIT, Q.CRIME))
def business_profiles(spark, sf_dir):
    book = load_book(spark, sf_dir)
    return business_profile(book.addresses, book.scores, book.third_party, book.property_risk, CONFIG)


@query(over_book("SELECT a.business_id, a.street_address, a.zip_code, a.county FROM address a", Q.ADDRESS))
def newest_addresses(spark, sf_dir):
    return latest_address(load_book(spark, sf_dir).addresses)


@query(over_book("SELECT DISTINCT business_id, credit_score FROM credit", Q.CREDIT))
def newest_credit_scores(spark, sf_dir):
    return latest_scores(load_book(spark, sf_dir).scores)


@query(over_book("""
SELECT b.policy_id, b.package_name, b.num_of_owners, q.offer_id, r.state
FROM bind b LEFT JOIN quote q ON q.quote_id = b.last_quote_id LEFT JOIN rated r ON r.job_id = q.job_id""",
                 Q.BIND, Q.QUOTE, Q.RATED))
def binds_with_quote_and_rating(spark, sf_dir):
    documents = bound_documents(
        load_book(spark, sf_dir), CONFIG, bind=["package_name", "num_of_owners"], quote=["offer_id"], rating=["state"]
    )
    return documents.select("policy_id", "package_name", "num_of_owners", "offer_id", "state")


_ATTRIBUTES = [c for c in P.ATTRIBUTES if c != "cob_industry"]


@query(over_book(f"SELECT policy_reference, {', '.join(_ATTRIBUTES)} FROM attrs WHERE policy_reference IS NOT NULL",
                 Q.months(CONFIG.through), *Q.ATTRIBUTE_STEPS))
def attributes_per_policy(spark, sf_dir):
    book = load_book(spark, sf_dir)
    return policy_attributes(book, CONFIG, _spine(book)).select("policy_reference", *_ATTRIBUTES)


@query(over_book("""
SELECT policy_reference, distribution_channel_attributed AS distribution_channel, agency_aggregator AS agency_aggregator_name,
       agency_type AS current_agencytype, package AS highest_status_package, policy_status_name AS highest_status_name
FROM company_metrics"""))
def distribution_attributes(spark, sf_dir):
    return company_metrics(load_book(spark, sf_dir).company_metrics)


# --- rating ------------------------------------------------------------------------------------


@query(over_orders("SELECT o_custkey AS business_id, min(day) AS customer_inception FROM days GROUP BY ALL"))
def first_order_per_customer(spark, sf_dir):
    days = orders_by_day(spark, sf_dir)
    return customer_inception(days.select(F.col("o_custkey").alias("business_id"), F.col("day").alias("start_date")))


_TERMS = [
    ("inception", "SELECT o_custkey AS business_id, min(day) AS customer_inception FROM days GROUP BY ALL"),
    ("terms", """
SELECT d.o_custkey AS business_id, d.o_orderkey, d.day AS eff_date, d.amount,
       CAST(date_diff('day', i.customer_inception, d.day) // 365 AS INTEGER) AS policy_term
FROM days d JOIN inception i ON i.business_id = d.o_custkey"""),
]


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = orders_by_day(spark, sf_dir).select(
        F.col("o_custkey").alias("business_id"), "o_orderkey", F.col("day").alias("eff_date"), "amount"
    )
    first = customer_inception(days.withColumnRenamed("eff_date", "start_date"))
    joined = days.join(first, "business_id")
    return joined.withColumn("policy_term", policy_term("customer_inception", "eff_date")).drop("customer_inception")


@query(over_orders("SELECT * FROM terms", *_TERMS))
def terms_of_orders(spark, sf_dir):
    return order_terms(spark, sf_dir)


@query(over_orders("""
SELECT DISTINCT a.business_id, a.o_orderkey, a.policy_term, a.amount, b.policy_term AS term_before, b.amount AS amount_before
FROM terms a
LEFT JOIN (SELECT * FROM terms QUALIFY rank() OVER (PARTITION BY business_id, policy_term ORDER BY eff_date DESC) = 1) b
  ON b.business_id = a.business_id AND b.policy_term = a.policy_term - 1""", *_TERMS))
def orders_beside_the_term_before(spark, sf_dir):
    carried = {"policy_term": "term_before", "amount": "amount_before"}
    return prior_term_pairs(order_terms(spark, sf_dir), carried, ["business_id", "o_orderkey", "policy_term", "amount"])


@query(over_orders("""
SELECT business_id, policy_term, count(DISTINCT o_orderkey) AS n_policies, count(DISTINCT key_before) AS n_earlier, count(*) AS n_pairs,
       CAST(sum(amount) AS DECIMAL(38,2)) AS amount, CAST(sum(amount_before) AS DECIMAL(38,2)) AS amount_before
FROM (SELECT a.business_id, a.policy_term, a.o_orderkey, a.amount, b.o_orderkey AS key_before, b.amount AS amount_before
      FROM terms a
      LEFT JOIN (SELECT * FROM terms QUALIFY rank() OVER (PARTITION BY business_id, policy_term ORDER BY eff_date DESC) = 1) b
        ON b.business_id = a.business_id AND b.policy_term = a.policy_term - 1)
GROUP BY business_id, policy_term""", *_TERMS))
def term_classes_of_orders(spark, sf_dir):
    carried = {"o_orderkey": "key_before", "amount": "amount_before"}
    keep = ["business_id", "o_orderkey", "policy_term", "amount"]
    return prior_term_classes(order_terms(spark, sf_dir), carried, keep, ["amount", "amount_before"])


@query("""
SELECT p_partkey, CAST(base AS DECIMAL(18,4)) AS pure_premium_base, CAST(above AS DECIMAL(18,4)) AS pure_premium_ilf,
       CAST(base + above AS DECIMAL(18,4)) AS pure_premium,
       CAST(CAST(base + above AS DECIMAL(18,4)) * ded * lcm AS DECIMAL(28,8)) AS manual_premium,
       CAST(CAST(CAST(base + above AS DECIMAL(18,4)) * ded * lcm AS DECIMAL(28,8)) * factor AS DECIMAL(33,10)) AS modified_premium,
       CASE WHEN p_size > 25 THEN 'Y' ELSE 'N' END AS tria_ind
FROM (SELECT *, CASE WHEN lim < 10000 THEN lim * 0.01 * 2.67 ELSE 100 * CAST(2.67 AS DECIMAL(4,2)) END AS base,
             CASE WHEN lim > 10000 THEN (lim - 10000) * 0.01 * 1.84 ELSE 0 END AS above
      FROM (SELECT p_partkey, p_size, CASE WHEN p_size = 1 THEN NULL ELSE CAST(p_size * 500 AS DECIMAL(18,0)) END AS lim,
                   CAST(1.10 AS DECIMAL(4,2)) AS ded, CAST(2 AS DECIMAL(4,2)) AS lcm, CAST(1.5 AS DECIMAL(4,2)) AS factor
            FROM part))""")
def tiered_premium_of_parts(spark, sf_dir):
    def rate(text: str) -> Column:
        return F.lit(text).cast("decimal(4,2)")

    limit = F.when(F.col("p_size") != 1, (F.col("p_size") * 500).cast("decimal(18,0)"))
    premium = rate_premium(limit, rate("2.67"), rate("1.84"), rate("1.10"), rate("2"), rate("1.5"))
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", *named(premium), tria_indicator(F.col("p_size") - 25).alias("tria_ind"))
