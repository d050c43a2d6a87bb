"""Dynamics, causal graphs, generated graphs and profiles of fits on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import causal as K
from ..operators import dynamics as D
from ..operators import graph as G
from ..session import day
from .base import query
from .calibration import _U
from .scoring import forecasts, rounded, _SC


@query(
    "stability",
    """WITH p AS (SELECT n_nationkey AS k, n_nationkey / CAST(10 AS DOUBLE) - 1.05 AS a, n_regionkey / CAST(3 AS DOUBLE) AS b FROM nation), s AS (SELECT k, a - b AS tr, 1 - a * b AS det FROM p), l AS (SELECT *, CASE WHEN tr * tr < 4 * det THEN tr / 2 ELSE (tr + sqrt(tr * tr - 4 * det)) / 2 END AS hi, CASE WHEN tr * tr < 4 * det THEN tr / 2 ELSE (tr - sqrt(tr * tr - 4 * det)) / 2 END AS lo FROM s)
SELECT k, CASE WHEN abs(hi) <= 1e-7 OR abs(lo) <= 1e-7 THEN 'marginal' WHEN hi > 0 AND lo < 0 THEN 'saddle' WHEN tr * tr < 4 * det THEN 'focus' ELSE 'node' END AS kind, hi < 0 AND lo < 0 AND abs(hi) > 1e-7 AS stable, round(hi, 5) AS leading FROM l""",
)
def stability(t):
    rows = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") / 10 - 1.05).alias("a"), (F.col("n_regionkey") / 3).alias("b"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return rounded(D.stability(rows, "k", ["x", "y"], lambda s, r: np.array([r["a"] * s[0] - s[1], s[0] - r["b"] * s[1]])), "leading", places=5)


@query(
    "bifurcation_scan",
    """WITH p AS (SELECT n_nationkey AS k, (n_nationkey - 9.5) / CAST(5 AS DOUBLE) AS r FROM nation) SELECT k, CAST(0 AS INTEGER) AS branch, round(CASE WHEN r > 0 THEN -sqrt(r) ELSE 0 END, 5) AS x, 'node' AS kind, true AS stable FROM p UNION ALL SELECT k, 1, 0.0, 'node', false FROM p WHERE r > 0 UNION ALL SELECT k, 2, round(sqrt(r), 5), 'node', true FROM p WHERE r > 0""",
)
def bifurcation_scan(t):
    """Equilibria of x' = r x - x^3 over a grid of r: one branch becomes three."""
    rows = t.nation.select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") - 9.5) / 5).alias("r"))
    out = D.equilibria(rows, "k", [[-2.0], [-0.5], [0.0], [0.5], [2.0]], lambda s, r: r["r"] * s - s**3)
    return rounded(out.select("k", "branch", F.col("state")[0].alias("x"), "kind", "stable"), "x", places=5)


@query("equilibria", "SELECT p_partkey AS k, CAST(i AS INTEGER) AS branch, round(CASE WHEN i = 0 THEN 0 ELSE p_size END, 4) AS x, i = 1 AS stable FROM part, (SELECT unnest([0, 1]) AS i)")
def equilibria(t):
    """Logistic growth to a level of its own per part."""
    rows = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("level"))
    out = D.equilibria(rows, "k", [[-0.1], [0.3], [60.0]], lambda s, r: s * (1 - s / r["level"]))
    return rounded(out.select("k", "branch", F.col("state")[0].alias("x"), "stable"), "x", places=4)


def daily_totals(t):
    return t.events.groupBy("event_type", day("ts").alias("d")).agg(F.sum("value").alias("v"))


@query("attractor_embedding")  # a kernel per series: tests use a known system
def attractor_embedding(t):
    return D.attractor(daily_totals(t), "event_type", "d", "v")


@query("lyapunov_series")  # a kernel per series: tests use a known system
def lyapunov_series(t):
    return D.lyapunov(daily_totals(t), "event_type", "d", "v", apart=2, horizon=5)


DAG = [("size", "price"), ("brand", "price"), ("brand", "demand"), ("price", "demand"), ("season", "price"), ("demand", "revenue"), ("price", "revenue")]


@query("causal_effects")  # rules on a small graph: tests compare with all paths
def causal_effects(t):
    names = sorted({n for e in DAG for n in e})
    rows = [(x, y, *(lambda got: (got[0], ",".join(got[1])))(K.identifiable(DAG, x, y, [n for n in names if n != "season"]))) for x in names for y in names if y in K.below(DAG, {x}) - {x}]
    return t.spark.createDataFrame(rows, "cause string, effect string, strategy string, through string")


@query("tested_implications", "SELECT 'l_quantity|l_discount' AS pair, round(corr(l_quantity, l_discount), 5) AS partial, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity|l_tax|l_discount', round((corr(l_quantity, l_tax) - corr(l_quantity, l_discount) * corr(l_tax, l_discount)) / sqrt((1 - pow(corr(l_quantity, l_discount), 2)) * (1 - pow(corr(l_tax, l_discount), 2))), 5), count(*) FROM lineitem")
def tested_implications(t):
    n = t.lineitem.count()
    rows = [("l_quantity|l_discount", K.partial_correlation(t.lineitem, "l_quantity", "l_discount"), n), ("l_quantity|l_tax|l_discount", K.partial_correlation(t.lineitem, "l_quantity", "l_tax", ["l_discount"]), n)]
    return rounded(t.spark.createDataFrame(rows, "pair string, partial double, n long"), "partial", places=5)


@query("small_world", f"WITH e AS (SELECT n_nationkey AS a, unnest([1, 2, 3]) AS k FROM nation) SELECT CAST(a AS BIGINT) AS a, CAST(k AS INTEGER) AS k, CAST(CASE WHEN {_U.format(repr('31|') + ' || a || ' + repr('|') + ' || k || ' + repr('|move'))} < 0.3 THEN floor({_U.format(repr('31|') + ' || a || ' + repr('|') + ' || k || ' + repr('|to'))} * 25) ELSE (a + k) % 25 END AS BIGINT) AS b FROM e")
def small_world_query(t):
    return G.small_world(t.nation, "n_nationkey", 25, 3, 0.3)


@query("random_graph", f"WITH n AS (SELECT n_nationkey AS a, n_regionkey AS c FROM nation) SELECT x.a AS a, y.a AS b FROM n x JOIN n y ON x.a < y.a WHERE {_U.format(repr('37|') + ' || x.a || ' + repr('|') + ' || y.a')} < CASE WHEN x.c = y.c THEN 0.6 ELSE 0.1 END")
def random_graph(t):
    """Blocks are regions: likely inside, rare between."""
    return G.block_model(t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community")), 0.6, 0.1)


@query(
    "profile_likelihood",
    "WITH s AS (SELECT regr_sxx(l_extendedprice, l_quantity) AS xx, regr_sxy(l_extendedprice, l_quantity) AS xy, regr_syy(l_extendedprice, l_quantity) AS yy, count(*) AS n FROM lineitem) SELECT CAST(1000 + 50 * i AS DOUBLE) AS slope, round(-0.5 * n * ln((yy - 2 * (1000 + 50 * i) * xy + pow(1000 + 50 * i, 2) * xx) / n), 2) AS log_likelihood FROM s, (SELECT unnest(range(21)) AS i)",
)
def profile_likelihood(t):
    """Log likelihood of a slope with the other parameters at their best: one pass for all grid points."""
    x, y = "l_quantity", "l_extendedprice"
    s = t.lineitem.agg(F.regr_sxx(y, x).alias("xx"), F.regr_sxy(y, x).alias("xy"), F.regr_syy(y, x).alias("yy"), F.count("*").alias("n"))  # one row
    b = F.col("slope")
    grid = t.spark.range(21).select((1000 + 50 * F.col("id")).cast("double").alias("slope"))
    return grid.crossJoin(s).select("slope", F.round(-0.5 * F.col("n") * F.log((F.col("yy") - 2 * b * F.col("xy") + b * b * F.col("xx")) / F.col("n")), 2).alias("log_likelihood"))


@query("fisher_information", f"WITH {_SC}, w AS (SELECT p * (1 - p) AS w, ln(p / (1 - p)) AS x FROM s) SELECT round(sum(w), 5) AS i00, round(sum(w * x), 5) AS i01, round(sum(w * x * x), 5) AS i11, round(sum(w) * sum(w * x * x) - pow(sum(w * x), 2), 3) AS determinant FROM w")
def fisher_information(t):
    """Information of a logistic model's two parameters, summed over rows."""
    p = F.col("p")
    w, x = p * (1 - p), F.log(p / (1 - p))
    out = forecasts(t).agg(F.sum(w).alias("i00"), F.sum(w * x).alias("i01"), F.sum(w * x * x).alias("i11"))
    out = out.withColumn("determinant", F.col("i00") * F.col("i11") - F.col("i01") ** 2)
    return rounded(rounded(out, "i00", "i01", "i11", places=5), "determinant", places=3)


@query(
    "local_sensitivity",
    """WITH f AS (SELECT l_returnflag AS g, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS base, sum(l_extendedprice * 1.01 * (1 - l_discount) * (1 + l_tax)) AS p, sum(l_extendedprice * (1 - l_discount * 1.01) * (1 + l_tax)) AS d, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax * 1.01)) AS t FROM lineitem GROUP BY 1)
SELECT g, 'price' AS parameter, round((p - base) / base / 0.01, 6) AS elasticity FROM f UNION ALL SELECT g, 'discount', round((d - base) / base / 0.01, 6) FROM f UNION ALL SELECT g, 'tax', round((t - base) / base / 0.01, 6) FROM f""",
)
def local_sensitivity(t):
    """Elasticities of revenue: all perturbed totals in one pass."""
    revenue = lambda p=1.0, d=1.0, x=1.0: F.sum(F.col("l_extendedprice") * p * (1 - F.col("l_discount") * d) * (1 + F.col("l_tax") * x))
    f = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(revenue().alias("base"), revenue(p=1.01).alias("price"), revenue(d=1.01).alias("discount"), revenue(x=1.01).alias("tax"))
    out = f.unpivot(["g", "base"], ["price", "discount", "tax"], "parameter", "v")
    return rounded(out.select("g", "parameter", ((F.col("v") - F.col("base")) / F.col("base") / 0.01).alias("elasticity")), "elasticity")
