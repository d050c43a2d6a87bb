"""Profiles and data-quality checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import profile as P
from ..session import epoch, r6
from .base import query

NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILE = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem" for c in NUMERIC
)


@query("table_profile", _PROFILE)
def table_profile(t):
    return P.table_profile(t.lineitem, NUMERIC)


@query(
    "text_structure_profile",
    """SELECT lang, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(max(length(text)) AS BIGINT) AS longest,
       CAST(sum(CASE WHEN contains(text, chr(0)) THEN 1 ELSE 0 END) AS BIGINT) AS n_binary FROM documents GROUP BY lang""",
)
def text_structure_profile(t):
    return P.text_profile(t.documents, "text", "lang")


@query(
    "numeric_column_scan",
    "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)) AS n_numeric, count(*) = count(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)) AS is_numeric FROM customer" for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
)
def numeric_column_scan(t):
    return P.numeric_columns(t.customer)


LINE_CHECKS = [
    C.NumericCheck("finite_price", "finite", ("l_quantity", "l_extendedprice"), group_columns=("l_returnflag",)),
    C.NumericCheck("discount_bounds", "bounds", ("l_discount", "l_tax"), group_columns=("l_linestatus",), lower=0.0, upper=0.07, tolerance=0.005),
    C.NumericCheck("share_sum", "sum_conservation", ("l_discount", "l_tax"), row_filters=(("l_returnflag", "A"),), reference_value=0.08, tolerance=0.05),
]
_FINITE = "SELECT 'finite_price' AS check_id, 'finite' AS operation, count(*) AS selected_row_count, count(DISTINCT l_returnflag) AS group_count, 2 * count(*) AS comparison_count, CAST(0 AS BIGINT) AS violation_count, CAST(0 AS DOUBLE) AS observed_worst_violation, CAST(0 AS DOUBLE) AS worst_excess, true AS passed FROM lineitem"
_BOUNDS = """SELECT 'discount_bounds' AS check_id, 'bounds' AS operation, count(*) AS selected_row_count, count(DISTINCT l_linestatus) AS group_count, 2 * count(*) AS comparison_count,
 CAST(sum(CASE WHEN a > 0.005 THEN 1 ELSE 0 END) + sum(CASE WHEN b > 0.005 THEN 1 ELSE 0 END) AS BIGINT) AS violation_count,
 round(greatest(max(a), max(b)), 6) AS observed_worst_violation, round(greatest(0, greatest(max(a), max(b)) - 0.005), 6) AS worst_excess,
 sum(CASE WHEN a > 0.005 THEN 1 ELSE 0 END) + sum(CASE WHEN b > 0.005 THEN 1 ELSE 0 END) = 0 AS passed
 FROM (SELECT l_linestatus, greatest(CAST(0 AS DOUBLE), -l_discount, l_discount - CAST(0.07 AS DOUBLE)) AS a, greatest(CAST(0 AS DOUBLE), -l_tax, l_tax - CAST(0.07 AS DOUBLE)) AS b FROM lineitem)"""
_SUM = """SELECT 'share_sum' AS check_id, 'sum_conservation' AS operation, count(*) AS selected_row_count, CAST(1 AS BIGINT) AS group_count, count(*) AS comparison_count,
 CAST(sum(CASE WHEN v > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS violation_count, round(max(v), 6) AS observed_worst_violation,
 round(greatest(0, max(v) - 0.05), 6) AS worst_excess, sum(CASE WHEN v > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) = 0 AS passed
 FROM (SELECT abs(l_discount + l_tax - CAST(0.08 AS DOUBLE)) AS v FROM lineitem WHERE l_returnflag = 'A')"""
PRICE_RISE = C.NumericCheck("price_rise", "monotonic", ("o_totalprice",), group_columns=("o_custkey",), time_column="o_orderdate", direction="increasing", tolerance=100.0, tie_columns=("o_orderkey",))
_MONO = """SELECT 'price_rise' AS check_id, 'monotonic' AS operation, count(*) AS selected_row_count, count(DISTINCT o_custkey) AS group_count, count(v) AS comparison_count,
 CAST(sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS BIGINT) AS violation_count, round(max(v), 6) AS observed_worst_violation, round(greatest(0, max(v) - 100), 6) AS worst_excess,
 sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) = 0 AS passed
 FROM (SELECT o_custkey, greatest(0, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - o_totalprice) AS g,
   CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 THEN greatest(0, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - o_totalprice) END AS v FROM orders)"""


def _rounded(report):
    return report.withColumn("observed_worst_violation", r6(F.col("observed_worst_violation"))).withColumn("worst_excess", r6(F.col("worst_excess")))


@query("check_finite", _FINITE)
def check_finite(t):
    return _rounded(C.run(t.lineitem, LINE_CHECKS[:1]))


@query("check_bounds", _BOUNDS)
def check_bounds(t):
    return _rounded(C.run(t.lineitem, LINE_CHECKS[1:2]))


@query("check_conservation", _SUM)
def check_conservation(t):
    return _rounded(C.run(t.lineitem, LINE_CHECKS[2:3]))


@query("check_monotonic", _MONO)
def check_monotonic(t):
    return _rounded(C.run(t.orders, [PRICE_RISE]))


@query("check_suite", f"{_FINITE}\nUNION ALL {_BOUNDS}\nUNION ALL {_SUM}\nUNION ALL {_MONO}")
def check_suite(t):
    return _rounded(C.run(t.lineitem, LINE_CHECKS).unionByName(C.run(t.orders, [PRICE_RISE])))


@query("check_duplicate_time", "SELECT o_custkey, epoch(o_orderdate) AS moment, count(*) AS n_rows FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def check_duplicate_time(t):
    return C.duplicate_times(t.orders.select("o_custkey", epoch("o_orderdate").alias("moment")), ["o_custkey"], "moment")


@query(
    "violation_report",
    """WITH c AS (
  SELECT l_orderkey AS step, 'quantity_cap' AS constraint_name, greatest(0, l_quantity - 45) AS v FROM lineitem
  UNION ALL SELECT l_orderkey, 'net_price', greatest(0, -(l_extendedprice * (1 - l_discount))) FROM lineitem
  UNION ALL SELECT l_orderkey, 'tax_discount_sum', greatest(0, abs(l_tax + l_discount - CAST(0.09 AS DOUBLE)) - CAST(0.06 AS DOUBLE)) FROM lineitem)
SELECT constraint_name, round(max(v), 6) AS max_violation, round(avg(v), 6) AS mean_violation, CAST(sum(CASE WHEN v > CAST(0.001 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS violating_steps,
 round(sum(CASE WHEN v > CAST(0.001 AS DOUBLE) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS violating_fraction, min(CASE WHEN v > CAST(0.001 AS DOUBLE) THEN step END) AS first_step
FROM c GROUP BY constraint_name""",
)
def violation_report(t):
    q = F.col("l_quantity") - 45
    net = -(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    both = F.abs(F.col("l_tax") + F.col("l_discount") - 0.09) - 0.06
    out = C.violation_report(t.lineitem.withColumnRenamed("l_orderkey", "step"), "step", {"quantity_cap": q, "net_price": net, "tax_discount_sum": both}, 0.001)
    return out.select("constraint_name", r6(F.col("max_violation")).alias("max_violation"), r6(F.col("mean_violation")).alias("mean_violation"), "violating_steps", r6(F.col("violating_fraction")).alias("violating_fraction"), "first_step")


@query(
    "cummax_repair",
    "SELECT o_custkey, o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS repaired FROM orders",
)
def cummax_repair(t):
    out = C.monotone_repair(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_custkey", "o_orderkey", r6(F.col("repaired")).alias("repaired"))
