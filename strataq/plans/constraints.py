"""Constraints, generated checks, arrays and picks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import constraints as C
from .base import query
from .scoring import rounded

CONSTRAINTS = [
    {"id": "b", "kind": "bounds", "columns": ["q"], "lower": 5.0, "upper": 40.0, "tolerance": 0.5},
    {"id": "n", "kind": "non_negativity", "columns": ["d"], "tolerance": 0.0},
    {"id": "s", "kind": "symmetry", "pairs": [("d", "x")], "tolerance": 0.01},
    {"id": "c", "kind": "conservation", "columns": ["d", "x"], "total": 0.1, "tolerance": 0.02},
]


def states(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_discount") - 0.01).alias("d"), F.col("l_tax").alias("x"))


@query(
    "penalty_terms",
    """WITH s AS (SELECT l_returnflag AS g, l_quantity AS q, l_discount - 0.01 AS d, l_tax AS x FROM lineitem)
SELECT g, count(*) AS n, round(sum(2 * pow(greatest(0, 5 - q - 0.5, q - 40 - 0.5), 2) + pow(greatest(0, -d), 2) + pow(greatest(0, abs(d - x) - 0.01), 2) + pow(greatest(0, abs(d + x - 0.1) - 0.02), 2)), 4) AS penalty FROM s GROUP BY g""",
)
def penalty_terms(t):
    s = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), (F.col("l_discount") - 0.01).alias("d"), F.col("l_tax").alias("x"))
    return rounded(s.groupBy("g").agg(F.count("*").alias("n"), F.sum(C.penalty(CONSTRAINTS, {"b": 2.0})).alias("penalty")), "penalty", places=4)


@query(
    "project_state",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount - 0.01 AS d, l_tax AS x FROM lineitem), b AS (SELECT *, greatest(5, least(40, q)) AS q1, greatest(0, d) AS d1 FROM s)
SELECT l_orderkey, l_linenumber, round(q1, 6) AS q, CASE WHEN d1 + x > 0 THEN round(d1 * (CAST(0.1 AS DOUBLE) / (d1 + x)), 8) ELSE 0.05 END AS d, CASE WHEN d1 + x > 0 THEN round(x * (CAST(0.1 AS DOUBLE) / (d1 + x)), 8) ELSE 0.05 END AS x FROM b""",
)
def project_state(t):
    """Box limits, then a total: the closed form of one sweep."""
    rules = [{"id": "b", "kind": "bounds", "columns": ["q"], "lower": 5.0, "upper": 40.0}, {"id": "n", "kind": "non_negativity", "columns": ["d"]}, {"id": "c", "kind": "conservation", "columns": ["d", "x"], "total": 0.1}]
    out = C.project(states(t), ["q", "d", "x"], rules).drop("moved", "left")
    return rounded(rounded(out, "q"), "d", "x", places=8)


@query("freeze_rule", "WITH c AS (SELECT DISTINCT p_brand AS csv_filename, CASE WHEN p_size < 25 THEN 'finite' ELSE 'bounds' END AS operation FROM part), f AS (SELECT csv_filename, bool_or(operation = 'finite') AS has_finite, CAST(sum(CASE WHEN operation <> 'finite' THEN 1 ELSE 0 END) AS BIGINT) AS substantive FROM c GROUP BY 1) SELECT *, (SELECT bool_and(has_finite) AND sum(substantive) > 0 FROM f) AS may_freeze FROM f")
def freeze_rule(t):
    return C.freeze_rule(t.part.select(F.col("p_brand").alias("csv_filename"), F.when(F.col("p_size") < 25, "finite").otherwise("bounds").alias("operation")).distinct())


@query(
    "generated_checks",
    """SELECT 'finite_states' AS id, count(*) AS n, CAST(sum(CASE WHEN l_quantity IS NULL OR l_tax IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM lineitem UNION ALL SELECT 'non_negative_stocks', count(*), CAST(sum(CASE WHEN l_tax < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem
UNION ALL SELECT 'conserved_all_A', count(*), CAST(sum(CASE WHEN abs(l_quantity + l_tax - 25) > 20 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem WHERE l_returnflag = 'A'""",
)
def generated_checks(t):
    """The specifications made for two stocks and one closed group, run over lineitem."""
    specs = C.generated_checks([("l_quantity", False), ("l_tax", True)], [("all", "A", ["l_quantity", "l_tax"], 25.0, 20.0)])
    one = t.lineitem
    bad = {"finite": lambda s: F.count_if(F.expr(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in s["columns"]))), "bounds": lambda s: F.count_if(F.expr(" OR ".join(f"{c} < {s['lower']}" for c in s["columns"]))), "sum_conservation": lambda s: F.count_if(F.abs(sum((F.col(c) for c in s["columns"][1:]), F.col(s["columns"][0])) - s["reference_value"]) > s["tolerance"])}
    out = None
    for s in specs:
        rows = one.where(F.col("l_returnflag") == s["row_filters"][0]["equals"]) if s["row_filters"] else one
        part = rows.agg(F.lit(s["id"]).alias("id"), F.count("*").alias("n"), bad[s["operation"]](s).alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


@query("conservation_report", "WITH s AS (SELECT o_orderpriority AS scenario, o_custkey AS replicate, o_orderkey AS tm, o_totalprice AS a, o_custkey + 0.0 AS b FROM orders), r AS (SELECT *, first_value(a + b) OVER (PARTITION BY scenario, replicate ORDER BY tm) AS initial FROM s) SELECT scenario, replicate, count(*) AS n, round(min(initial), 2) AS initial, round(max(abs(a + b - initial)), 2) AS drift, round(min(least(a, b)), 2) AS least_stock, min(least(a, b)) >= 0 AS non_negative, max(abs(a + b - initial)) <= 1e-9 * greatest(1, abs(min(initial))) AS conserved FROM r GROUP BY 1, 2")
def conservation_report(t):
    s = t.orders.select(F.col("o_orderpriority").alias("scenario"), F.col("o_custkey").alias("replicate"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") + 0.0).alias("b"))
    return rounded(C.conservation_report(s, ["scenario", "replicate"], ["a", "b"], "at"), "initial", "drift", "least_stock", places=2)


@query(
    "array_ops",
    """WITH a AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem GROUP BY 1)
SELECT k, CAST(len(x) AS INTEGER) AS n, CAST(coalesce(list_position(list_transform(x, lambda v: v > 40), true), 0) - 1 AS INTEGER) AS first_over, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS argmax, CAST(len(list_distinct(x)) AS INTEGER) AS distinct_values, round(list_sum(x), 2) AS total FROM a""",
)
def array_ops(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("r")).select("k", F.col("r.l_quantity").alias("x"))
    first = F.coalesce(F.array_position(F.transform("x", lambda v: v > 40), True), F.lit(0)) - 1
    return a.select("k", F.size("x").alias("n"), first.cast("int").alias("first_over"), (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("argmax"), F.size(F.array_distinct("x")).alias("distinct_values"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 2).alias("total"))


@query("top_exemplars", "SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def top_exemplars(t):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("place", F.row_number().over(w)).where("place <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query("least_visited", "WITH v AS (SELECT l_partkey AS part, count(*) AS visits, min(l_shipdate) AS since FROM lineitem GROUP BY 1) SELECT p_brand, part, visits FROM (SELECT p_brand, part, visits, row_number() OVER (PARTITION BY p_brand ORDER BY visits, since, part) AS k FROM v JOIN part ON p_partkey = part) WHERE k = 1")
def least_visited(t):
    v = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("visits"), F.min("l_shipdate").alias("since"))
    best = F.min_by(F.struct("part", "visits"), F.struct("visits", "since", "part"))
    return v.join(t.part, F.col("part") == F.col("p_partkey")).groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.part", "b.visits")


@query("row_sample", "SELECT * FROM region ORDER BY r_regionkey LIMIT 3")
def row_sample(t):
    return t.region.orderBy("r_regionkey").limit(3)  # the limit is the feature
