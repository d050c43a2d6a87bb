"""Bounded fits, their intervals, and a scenario against its ablation, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting as B
from ..operators import simulation as S
from .base import query
from .calibration import _U
from .scoring import rounded


@query(
    "bounded_fit",
    """WITH m AS (SELECT l_returnflag AS g, least(-0.01, greatest(-1, regr_slope(l_extendedprice / 1000, l_quantity))) AS b, regr_slope(l_extendedprice / 1000, l_quantity) AS free, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, count(*) AS n FROM lineitem GROUP BY 1)
SELECT g, round(my - b * mx, 4) AS intercept, round(b, 4) AS slope, free >= -0.01 OR free <= -1 AS slope_at_bound, true AS converged, n FROM m""",
)
def bounded_fit(t):
    """Price on quantity per return flag, the slope held in [-1, -0.01]."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fits = B.bounded_fits(rows, "g", lambda p: p[0] + p[1] * F.col("x"), "y", [0.0, -0.5], [-1e6, -1.0], [1e6, -0.01])
    out = [(g, *f["terminal"], f["at_bound"][1], f["converged"], f["n"]) for g, f in fits.items()]
    return rounded(t.spark.createDataFrame(out, "g string, intercept double, slope double, slope_at_bound boolean, converged boolean, n long"), "intercept", "slope", places=4)


_BOOT = _U.format("'7|' || draw || '|' || i")


@query(
    "residual_bootstrap",
    f"""WITH o AS (SELECT CAST(l_quantity AS BIGINT) - 1 AS i, l_quantity AS x, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM o), z AS (SELECT i, x, a + b * x AS f, y - a - b * x AS z, n FROM o, m), r AS (SELECT *, unnest(range(40)) AS draw FROM z), d AS (SELECT draw, r.x, r.f + q.z AS y FROM (SELECT *, CAST(floor({_BOOT} * n) AS BIGINT) AS pick FROM r) r JOIN z q ON q.i = r.pick), g AS (SELECT draw, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM d GROUP BY draw)
SELECT 'intercept' AS parameter, round(quantile_cont(a, 0.025), 4) AS lower, round(quantile_cont(a, 0.975), 4) AS upper, round(stddev_samp(a), 4) AS standard_error, count(*) AS used FROM g UNION ALL SELECT 'slope', round(quantile_cont(b, 0.025), 4), round(quantile_cont(b, 0.975), 4), round(stddev_samp(b), 4), count(*) FROM g""",
)
def residual_bootstrap(t):
    """Intervals of mean price on quantity, from 40 redrawn sets of residuals."""
    rows = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg((F.avg("l_extendedprice") / 1000).alias("y")).withColumn("i", F.col("x").cast("long") - 1)
    line = lambda p: p[0] + p[1] * F.col("x")
    wide = ([-1e6, -1e6], [1e6, 1e6])
    fit = B.bounded_fits(rows.withColumn("one", F.lit(0)), "one", line, "y", [0.0, 0.0], *wide)[0]
    got = B.residual_bootstrap(rows, "i", line, "y", fit["terminal"], *wide, draws=40)
    out = [(n, float(got["lower"][j]), float(got["upper"][j]), float(got["standard_error"][j]), got["used"]) for j, n in enumerate(("intercept", "slope"))]
    return rounded(t.spark.createDataFrame(out, "parameter string, lower double, upper double, standard_error double, used long"), "lower", "upper", "standard_error", places=4)


def _next(state: str, pull: str, k: int) -> str:
    return f"SELECT s.node, 1 / (1 + exp(-4 * (coalesce(p, 0) + drift + 0.05 * ({_U.format(repr('23|') + ' || s.node || ' + repr(f'|{k}'))} - 0.5)))) AS x, drift FROM {state} s LEFT JOIN {pull} ON {pull}.node = s.node"


def _pull(state: str, edges: str) -> str:
    return f"SELECT dst AS node, sum(weight * (x - 0.5)) AS p FROM {edges} JOIN {state} ON src = {state}.node GROUP BY 1"


@query(
    "scenario_ablation",
    f"""WITH s0 AS (SELECT n_nationkey AS node, n_regionkey / CAST(5 AS DOUBLE) AS x, n_regionkey / CAST(20 AS DOUBLE) - 0.1 AS drift FROM nation), e AS (SELECT c_nationkey AS src, c_custkey % 25 AS dst, avg(c_acctbal) / 20000 AS weight FROM customer GROUP BY 1, 2), z AS (SELECT src, dst, 0 AS weight FROM e), p1 AS ({_pull("s0", "e")}), s1 AS ({_next("s0", "p1", 1)}), p2 AS ({_pull("s1", "e")}), s2 AS ({_next("s1", "p2", 2)}), q1 AS ({_pull("s0", "z")}), u1 AS ({_next("s0", "q1", 1)}), q2 AS ({_pull("u1", "z")}), u2 AS ({_next("u1", "q2", 2)})
SELECT s2.node, round(s2.x, 6) AS coupled, round(u2.x, 6) AS uncoupled, round(s2.x - u2.x, 6) AS difference FROM s2 JOIN u2 ON u2.node = s2.node""",
)
def scenario_ablation(t):
    n = t.nation.select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") / 5).alias("x"), (F.col("n_regionkey") / 20 - 0.1).alias("drift"))
    e = t.customer.groupBy(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).alias("dst")).agg((F.avg("c_acctbal") / 20000).alias("weight"))
    return rounded(S.ablation(n, e, 2, t.spark), "coupled", "uncoupled", "difference")
