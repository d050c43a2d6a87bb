"""Estimation, designs, sensitivity, queueing and simulations on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import estimation as E
from ..operators import simulation as S
from ..session import day, epoch
from .base import query
from .calibration import _U
from .graphs import edges
from .scoring import rounded


@query("least_squares", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem) SELECT 'one' AS term, round(a, 4) AS estimate, round(r2, 8) AS r2, n FROM m UNION ALL SELECT 'l_quantity', round(b, 4), round(r2, 8), n FROM m")
def least_squares(t):
    f = E.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return rounded(t.spark.createDataFrame([(n, float(b), float(f["r2"]), f["n"]) for n, b in zip(f["names"], f["beta"])], "term string, estimate double, r2 double, n long"), "estimate", places=4).withColumn("r2", F.round("r2", 8))


@query(
    "parameter_uncertainty",
    """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem), v AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s)
SELECT 'one' AS term, round(sqrt(s2 * (1 / CAST(n AS DOUBLE) + mx * mx / sxx)), 3) AS standard_error FROM v UNION ALL SELECT 'l_quantity', round(sqrt(s2 / sxx), 3) FROM v""",
)
def parameter_uncertainty(t):
    f = E.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(n, round(float(s), 3)) for n, s in zip(f["names"], f["standard_error"])], "term string, standard_error double")


@query("practical_identifiability")  # eigenvectors of a Gram matrix: tested on known designs
def practical_identifiability(t):
    df = t.lineitem.select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"), "l_discount", "l_extendedprice")
    got = E.identifiability(E.least_squares(df, ["l_quantity", "twice", "l_discount"], "l_extendedprice"))
    return t.spark.createDataFrame([(got["verdict"], a, b, round(r, 4)) for a, b, r in got["pairs"]], "verdict string, a string, b string, correlation double")


@query(
    "best_family",
    """WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT g, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_intercept(CASE WHEN y > 0 THEN ln(y) END, x) AS c, regr_slope(CASE WHEN y > 0 THEN ln(y) END, x) AS d FROM r GROUP BY g),
e AS (SELECT g, count(*) AS n, sum(pow(y - a - b * x, 2)) AS lin, sum(pow(y - exp(c + d * x), 2)) AS ex FROM r JOIN f USING (g) GROUP BY g) SELECT g, n, CASE WHEN lin <= ex THEN 'linear' ELSE 'exponential' END AS family, round(least(lin, ex) / 1e6, 1) AS rss FROM e""",
)
def best_family(t):
    out = E.best_family(t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "g", "x", "y")
    return out.withColumn("rss", F.round(F.col("rss") / 1e6, 1))


@query("stlsq")  # thresholding of a Gram matrix: tests recover a known equation
def stlsq(t):
    terms = E.power_terms({"q": F.col("l_quantity") / 50, "d": F.col("l_discount") * 10}, 2)
    df = t.lineitem.select(*[c.alias(k) for k, c in terms.items()], (F.col("l_extendedprice") / 50000).alias("price"))
    got = E.stlsq(df, list(terms), "price", 0.05)
    return t.spark.createDataFrame([(x, round(float(b), 4), bool(b)) for x, b in zip(terms, got["beta"])], "term string, coefficient double, kept boolean")


@query(
    "error_parts",
    """WITH p AS (SELECT l_returnflag AS g, l_linenumber AS r, count(*) AS n, avg(l_extendedprice) / 1000 AS m, coalesce(var_samp(l_extendedprice / 1000), 0) AS v, avg(l_quantity) * 1.5 AS f, sum(pow(l_extendedprice / 1000 - l_quantity * 1.5, 2)) AS e FROM lineitem GROUP BY 1, 2), s AS (SELECT g, sum(e) / sum(n) AS total, sum(v * (n - 1)) / sum(n - 1) AS noise, sum(n * pow(m - f, 2)) / sum(n) AS gap, count(*) / CAST(sum(n) AS DOUBLE) AS share FROM p GROUP BY g)
SELECT g, round(total, 4) AS total, round(noise, 4) AS noise, round(gap, 4) AS mean_gap, round(greatest(0, gap - noise * share), 4) AS discrepancy FROM s""",
)
def error_parts(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("r"), (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_quantity") * 1.5).alias("f"))
    return rounded(E.error_parts(df, "g", "x", "f", "r"), "total", "noise", "mean_gap", "discrepancy", places=4)


_SOBOL = ["sin({0}) + 7 * pow(sin({1}), 2) + 0.1 * pow({2}, 4) * sin({0})".format(*[f"(2 * pi() * x{j} - pi())" for j in range(3)])]


@query(
    "sobol_ishigami",
    "WITH r AS (SELECT i, m FROM (SELECT unnest(range(1024)) AS i), (SELECT unnest([-2, -1, 0, 1, 2]) AS m)), d AS (SELECT i, m, "
    + ", ".join(f"CASE WHEN m = -1 OR m = {j} THEN {_U.format(repr('13|') + ' || i || ' + repr(f'|b{j}'))} ELSE {_U.format(repr('13|') + ' || i || ' + repr(f'|a{j}'))} END AS x{j}" for j in range(3))
    + f""" FROM r), y AS (SELECT i, m, {_SOBOL[0]} AS y FROM d), v AS (SELECT var_pop(y) AS v FROM y WHERE m < 0)
SELECT CAST(z.m AS INTEGER) AS factor, round(avg(b.y * (z.y - a.y)) / max(v), 6) AS first_order, round(avg(pow(a.y - z.y, 2)) / 2 / max(v), 6) AS total FROM y z JOIN y a ON a.i = z.i AND a.m = -2 JOIN y b ON b.i = z.i AND b.m = -1, v WHERE z.m >= 0 GROUP BY z.m""",
)
def sobol_ishigami(t):
    d = E.sobol_design(t.spark, 3, 1024)
    return rounded(E.sobol_indices(d.withColumn("y", E.ishigami(F.col("x0"), F.col("x1"), F.col("x2")))), "first_order", "total")


@query("morris_ishigami")  # the design is keyed draws in an order of their own: tests check its rules
def morris_ishigami(t):
    d = E.morris_design(t.spark, 3, 200)
    return rounded(E.morris_effects(d.withColumn("y", E.ishigami(F.col("x0"), F.col("x1"), F.col("x2")))), "mu", "mu_star", "sigma")


@query(
    "mmc_metrics",
    """WITH RECURSIVE l AS (SELECT n_nationkey AS k, 1 + n_nationkey % 7 * CAST(0.9 AS DOUBLE) AS lam, CAST(1.5 AS DOUBLE) AS mu, 2 + n_nationkey % 3 AS c FROM nation), b(k, i, x) AS (SELECT k, 0, CAST(1 AS DOUBLE) FROM l UNION ALL SELECT b.k, i + 1, (lam / mu) * x / (i + 1 + (lam / mu) * x) FROM b JOIN l USING (k) WHERE i < c), f AS (SELECT l.*, x AS eb, x / (1 - lam / mu / c * (1 - x)) AS ec FROM l JOIN b ON b.k = l.k AND b.i = l.c)
SELECT k, round(lam / mu / c, 6) AS utilisation, round(CASE WHEN lam / mu < c THEN ec / (c * mu - lam) END, 6) AS mean_wait, round(CASE WHEN lam / mu < c THEN lam * ec / (c * mu - lam) END, 6) AS mean_queue, round(CASE WHEN lam / mu < c THEN ec / (c * mu - lam) + 1 / mu END, 6) AS mean_time FROM f""",
)
def mmc_metrics(t):
    k = F.col("n_nationkey")
    got = E.mmc(1 + k % 7 * 0.9, F.lit(1.5), (2 + k % 3).cast("int"))
    return rounded(t.nation.select(k.alias("k"), *[c.alias(n) for n, c in got.items()]), *got)


@query(
    "mmck_metrics",
    """WITH l AS (SELECT n_nationkey AS k, 1 + n_nationkey % 5 * CAST(0.8 AS DOUBLE) AS lam FROM nation), p AS (SELECT k, lam, n, pow(lam, n) / CASE WHEN n = 0 THEN 1 WHEN n = 1 THEN 1 ELSE 2 * pow(2, n - 2) END AS x FROM l, (SELECT unnest(range(6)) AS n)), s AS (SELECT k, lam, sum(x) AS z, sum(n * x) AS m, max(CASE WHEN n = 5 THEN x END) AS last FROM p GROUP BY 1, 2)
SELECT k, round(last / z, 8) AS blocked, round(m / z, 6) AS mean_number, round(lam * (1 - last / z), 6) AS throughput, round(m / z / (lam * (1 - last / z)), 6) AS mean_time FROM s""",
)
def mmck_metrics(t):
    got = E.mmck(1 + F.col("n_nationkey") % 5 * 0.8, F.lit(1.0), 2, 5)
    return rounded(rounded(t.nation.select(F.col("n_nationkey").alias("k"), *[c.alias(n) for n, c in got.items()]), "mean_number", "throughput", "mean_time"), "blocked", places=8)


_ARR = f"a AS (SELECT k, i, sum(-ln(1 - least({_U.format(repr('17|') + ' || k || ' + repr('|') + ' || i')}, 1 - 1e-12)) / rate) OVER (PARTITION BY k ORDER BY i) AS t FROM (SELECT n_nationkey AS k, 1 + n_regionkey / CAST(2 AS DOUBLE) AS rate, unnest(range(200)) AS i FROM nation))"


@query("poisson_arrivals", f"WITH {_ARR} SELECT k, count(*) AS n, round(max(t), 6) AS last_at, round(count(*) / max(t), 6) AS rate FROM a GROUP BY k")
def poisson_arrivals(t):
    a = S.poisson_arrivals(t.nation.select(F.col("n_nationkey").alias("k"), (1 + F.col("n_regionkey") / 2).alias("rate")), "k", "rate", 200)
    return rounded(a.groupBy("k").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), (F.count("*") / F.max("at")).alias("rate")), "last_at", "rate")


_REQ = "q AS (SELECT user_id AS k, event_id AS i, epoch(ts) AS t, value * 1000 AS s FROM events), u AS (SELECT *, sum(coalesce(p, 0)) OVER (PARTITION BY k ORDER BY i) AS u FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY i) - (t - lag(t) OVER (PARTITION BY k ORDER BY i)) AS p FROM q)), w AS (SELECT k, i, t, s, u - min(u) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS wait FROM u)"


def served(t):
    q = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), epoch("ts").alias("at"), (F.col("value") * 1000).alias("service"))
    return S.single_server(q, "k", "i", "at", "service")


@query("single_server", f"WITH {_REQ} SELECT k, i, round(wait, 3) AS wait FROM w")
def single_server(t):
    return rounded(served(t).select("k", "i", "wait"), "wait", places=3)


@query("station_rollup", f"WITH {_REQ}, p AS (SELECT k, count(*) AS n, avg(CASE WHEN wait + s <= 50000 THEN 1.0 ELSE 0.0 END) AS slo, max(t + wait + s) - min(t) AS span, sum(wait + s) AS sojourn, sum(s) AS busy FROM w GROUP BY k) SELECT k, n, round(slo, 6) AS slo_met, round(n / span, 9) AS throughput, round(busy / span, 6) AS utilisation, round(sojourn / span, 6) AS mean_number, round(n / span * sojourn / n, 6) AS little FROM p")
def station_rollup(t):
    return rounded(rounded(S.station_rollup(served(t), "k", "at", "service", 50000.0), "slo_met", "utilisation", "mean_number", "little"), "throughput", places=9)


@query("trace_summary", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS classes, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS burst_fraction, round(max(value) / avg(value), 6) AS tail_ratio FROM events GROUP BY 1")
def trace_summary(t):
    return rounded(S.trace_summary(t.events, "user_id", "event_type", "value", F.col("value") > 100), "burst_fraction", "tail_ratio")


@query("stock_flow")  # integration: tests compare with the closed form
def stock_flow(t):
    """Decay towards a level, one scenario per region: RK4."""
    start = t.nation.select(F.col("n_regionkey").cast("string").alias("scenario"), F.col("n_nationkey").alias("replicate"), F.lit(1.0).alias("x"), (1 + F.col("n_regionkey")).cast("double").alias("level"))
    out = S.integrate(start, ["x"], lambda at, x, row: np.array([0.5 * (row["level"] - x[0])]), 40, 0.1)
    return rounded(out.where("step = 40").groupBy("scenario").agg(F.avg("x").alias("x"), F.count("*").alias("n")), "x")


@query("what_if", "SELECT scenario, p_partkey AS k, price FROM (SELECT 'base' AS scenario, p_partkey, p_retailprice AS price FROM part UNION ALL SELECT 'clamped', p_partkey, 100.0 FROM part)")
def what_if(t):
    base = t.part.select(F.lit("base").alias("scenario"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"))
    return S.what_if(base, "base", "clamped", {"price": 100.0})


@query("influence_rollout")  # iterated sigmoid: tests compare with plain numpy
def influence_rollout(t):
    n = t.nation.select(F.col("n_nationkey").alias("node"), F.lit(0.5).alias("x"), (F.col("n_regionkey") / 20 - 0.1).alias("drift"))
    e = t.customer.groupBy(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).alias("dst")).agg((F.avg("c_acctbal") / 20000).alias("weight"))
    return rounded(S.influence(n, e, 4, t.spark), "x")


@query("cascade_rollout")  # keyed draws over steps: tests compare with plain Python
def cascade_rollout(t):
    e = edges(t)
    both = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    seeds = e.orderBy("a").select(F.col("a").alias("node")).distinct().orderBy("node").limit(3)
    active = S.cascade(both, seeds, t.spark, 6, replicates=2, hazard=0.05)
    return rounded(S.cascade_stats(active, "replicate", "step"), "mean_age", "age_spread", "early_share")


@query(
    "activation_stats",
    """WITH a AS (SELECT event_type AS g, user_id, min(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS d FROM events GROUP BY 1, 2), p AS (SELECT g, d, count(*) AS k FROM a GROUP BY 1, 2), e AS (SELECT g, min(d) AS s, max(d) AS z, sum(k) AS n FROM p GROUP BY g), r AS (SELECT p.g, d - s AS age, k, n, z - s AS span, sum(k) OVER (PARTITION BY p.g ORDER BY d) AS so FROM p JOIN e ON e.g = p.g)
SELECT g, CAST(max(n) AS BIGINT) AS size, max(age) AS duration, min(CASE WHEN 2 * so >= n THEN age END) AS half_time, round(sum(age * k) / CAST(sum(k) AS DOUBLE), 6) AS mean_age, round(sqrt(greatest(0, sum(age * age * k) / CAST(sum(k) AS DOUBLE) - pow(sum(age * k) / CAST(sum(k) AS DOUBLE), 2))), 6) AS age_spread, max(k) AS peak, arg_min(age, {'a': -k, 'b': age}) AS peak_age, round(sum(CASE WHEN age <= 0.1 * span THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 6) AS early_share FROM r GROUP BY g""",
)
def activation_stats(t):
    a = t.events.groupBy(F.col("event_type").alias("g"), "user_id").agg(F.min(day("ts")).alias("d"))
    return rounded(S.cascade_stats(a, "g", "d"), "mean_age", "age_spread", "early_share")
