"""Calibration, resampling, laws and separability on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..session import epoch
from .base import query
from .scoring import forecasts, rounded, _SC

_ENS = "e AS (SELECT l_orderkey AS k, l_quantity AS x, o_totalprice / 10000 AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def ensemble(t):
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("o_totalprice") / 10000).alias("y"))


_PIT = f"{_ENS}, p AS (SELECT k, count(*) AS members, (sum(CASE WHEN x < y THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN x = y THEN 1 ELSE 0 END)) / CAST(count(*) AS DOUBLE) AS pit FROM e GROUP BY k)"


@query("pit_histogram", f"WITH {_PIT}, h AS (SELECT CAST(least(floor(pit * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY 1) SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN h ON h.bin = r.bin")
def pit_histogram(t):
    return C.pit_histogram(C.pit(ensemble(t), "k", "x", "y"))


@query("pit_uniformity", f"WITH {_PIT}, r AS (SELECT pit, row_number() OVER (ORDER BY pit) AS i, count(*) OVER () AS n FROM p) SELECT round(max(greatest(i / CAST(n AS DOUBLE) - pit, pit - (i - 1) / CAST(n AS DOUBLE))), 8) AS ks, max(n) AS n FROM r")
def pit_uniformity(t):
    return rounded(C.ks_uniform(C.pit(ensemble(t), "k", "x", "y"), "pit"), "ks", places=8)


@query(
    "interval_coverage",
    f"WITH {_ENS}, l AS (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS nominal), q AS (SELECT k, min(y) AS y, list(x) AS xs FROM e GROUP BY k), "
    + "i AS ("
    + " UNION ALL ".join(f"SELECT CAST({v} AS DOUBLE) AS nominal, k, min(y) AS y, quantile_cont(x, {(1 - v) / 2}) AS lo, quantile_cont(x, {1 - (1 - v) / 2}) AS hi FROM e GROUP BY k" for v in (0.5, 0.8, 0.9))
    + ") SELECT nominal, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS empirical, round(avg(hi - lo), 6) AS mean_width, count(*) AS n FROM i GROUP BY nominal",
)
def interval_coverage(t):
    return rounded(C.interval_coverage(ensemble(t), "k", "x", "y"), "empirical", "mean_width")


_STATS = """s AS (SELECT event_type AS g, user_id AS r, value AS v, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY epoch(ts), event_id) AS b, avg(value) OVER (PARTITION BY event_type, user_id) AS m FROM events),
o AS (SELECT g, r, avg(v) AS mean, coalesce(var_samp(v), 0) AS variance, sqrt(coalesce(var_samp(v), 0)) AS standard_deviation, max(v) AS max, min(v) AS min, max(v) - min(v) AS range,
 CASE WHEN sum((v - m) * (v - m)) > 1e-9 THEN coalesce(sum((v - m) * (b - m)), 0) / sum((v - m) * (v - m)) ELSE 0 END AS lag1_autocorrelation FROM s GROUP BY g, r),
u AS (SELECT g, r, statistic, round(value, 6) AS value FROM (UNPIVOT o ON mean, variance, standard_deviation, max, min, range, lag1_autocorrelation INTO NAME statistic VALUE value)), f AS (SELECT g, min(r) AS r FROM u GROUP BY g)"""


@query(
    "posterior_predictive",
    f"""WITH {_STATS}, x AS (SELECT u.g, statistic, value AS observed FROM u JOIN f USING (g, r)), j AS (SELECT u.g, u.statistic, observed, u.value FROM u JOIN f ON f.g = u.g AND f.r <> u.r JOIN x ON x.g = u.g AND x.statistic = u.statistic)
SELECT g, statistic, round(max(observed), 4) AS observed, round(avg(value), 4) AS replicate_mean, round(avg(CASE WHEN value >= observed THEN 1.0 ELSE 0.0 END), 6) AS p_value, count(*) AS replicates,
 CASE WHEN avg(CASE WHEN value >= observed THEN 1.0 ELSE 0.0 END) < 0.05 THEN 'observed_above_replicates' WHEN avg(CASE WHEN value >= observed THEN 1.0 ELSE 0.0 END) > 0.95 THEN 'observed_below_replicates' ELSE 'not_flagged' END AS direction FROM j GROUP BY g, statistic""",
)
def posterior_predictive(t):
    """Users are replicates of an event type; the first user is the observation."""
    rows = t.events.select(F.col("event_type").alias("g"), F.col("user_id").alias("r"), epoch("ts").alias("at"), "event_id", "value")
    s = C.statistics_of(rows, ["g", "r"], "at", ["event_id"], "value").withColumn("value", F.round("value", 6) + 0.0)
    first = rows.groupBy("g").agg(F.min("r").alias("f"))
    s = s.join(F.broadcast(first), "g")  # one row per event type
    return rounded(rounded(C.predictive_check(s.where("r <> f").drop("f"), s.where("r = f"), ["g"]), "p_value"), "observed", "replicate_mean", places=4)


_U = "('0x' || substr(sha256({}), 1, 12))::BIGINT / CAST(281474976710656 AS DOUBLE)"
_W = " + ".join(f"CASE WHEN u >= CAST({c!r} AS DOUBLE) THEN 1 ELSE 0 END" for c in C._poisson_cuts())


@query(
    "bootstrap_losses",
    f"""WITH {_SC}, l AS (SELECT g, doc_id, (p - y) * (p - y) AS loss FROM s), b AS (SELECT g, loss, b, {_U.format("'7|' || b || '|' || doc_id")} AS u FROM l, (SELECT unnest(range(400)) AS b)),
d AS (SELECT g, b, sum(({_W}) * loss) / nullif(sum({_W}), 0) AS m FROM b GROUP BY g, b), q AS (SELECT g, quantile_cont(m, 0.1) AS lo, quantile_cont(m, 0.9) AS hi FROM d WHERE m IS NOT NULL GROUP BY g)
SELECT g, round(avg(loss), 6) AS point, count(*) AS units, round(max(lo), 6) AS low, round(max(hi), 6) AS high FROM l JOIN q USING (g) GROUP BY g""",
)
def bootstrap_losses(t):
    losses = forecasts(t).select("g", "doc_id", ((F.col("p") - F.col("y")) ** 2).alias("loss"))
    return rounded(C.bootstrap(losses, "doc_id", "loss", ["g"]), "point", "low", "high")


@query(
    "separability",
    f"""WITH r AS (SELECT event_type AS m, value AS v, CASE WHEN {_U.format("'fold|' || event_id")} < 0.5 THEN 0 ELSE 1 END AS fold FROM events), s AS (SELECT m, avg(v) AS mean, var_samp(v) AS s2 FROM r GROUP BY m), p AS (SELECT a.m AS l, b.m AS r FROM s a JOIN s b ON a.m < b.m),
k AS (SELECT p.l, p.r, r.m, v, fold, rank() OVER (PARTITION BY p.l, p.r ORDER BY v) + (count(*) OVER (PARTITION BY p.l, p.r, v) - 1) / CAST(2 AS DOUBLE) AS rk FROM p JOIN r ON r.m = p.l OR r.m = p.r),
a AS (SELECT l, r, (sum(CASE WHEN m = r THEN rk END) - count(CASE WHEN m = r THEN 1 END) * (count(CASE WHEN m = r THEN 1 END) + 1) / CAST(2 AS DOUBLE)) / (CAST(count(CASE WHEN m = r THEN 1 END) AS DOUBLE) * count(CASE WHEN m = l THEN 1 END)) AS auc FROM k GROUP BY l, r),
f AS (SELECT m, 1 - fold AS fold, avg(v) AS mean, greatest(var_pop(v), 1e-12) AS s2 FROM r GROUP BY m, fold),
t AS (SELECT k.l, k.r, CASE WHEN k.m = k.l THEN -0.5 * (ln(x.s2) + pow(v - x.mean, 2) / x.s2) >= -0.5 * (ln(y.s2) + pow(v - y.mean, 2) / y.s2) ELSE -0.5 * (ln(y.s2) + pow(v - y.mean, 2) / y.s2) > -0.5 * (ln(x.s2) + pow(v - x.mean, 2) / x.s2) END AS hit FROM k JOIN f x ON x.m = k.l AND x.fold = k.fold JOIN f y ON y.m = k.r AND y.fold = k.fold),
c AS (SELECT l, r, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy FROM t GROUP BY l, r)
SELECT a.l AS "left", a.r AS "right", round(auc, 6) AS auc, round((y.mean - x.mean) / sqrt((x.s2 + y.s2) / 2), 6) AS difference, round(accuracy, 4) AS accuracy FROM a JOIN s x ON x.m = a.l JOIN s y ON y.m = a.r JOIN c ON c.l = a.l AND c.r = a.r""",
)
def separability(t):
    return rounded(rounded(C.separability(t.events, "event_type", "value", "event_id"), "auc", "difference"), "accuracy", places=4)


@query("platt_recalibration")
def platt_recalibration(t):
    """Iterative: tests compare with the same steps in plain numpy."""
    rows = forecasts(t).withColumn("x", F.log(F.col("p") / (1 - F.col("p"))))
    beta = C.platt(rows, "x", "y")
    q = C.recalibrate(rows, "x", beta)
    return rounded(rows.groupBy("g").agg(F.count("*").alias("n"), F.avg((q - F.col("y")) ** 2).alias("brier"), F.avg(q).alias("mean_p")), "brier", "mean_p")


def _poly_sql(x, cs):
    out = f"({cs[0]!r})"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def _inverse_sql(u):
    lo, hi = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))"
    q = f"({u} - 0.5)"
    return f"CASE WHEN {u} < 0.02425 THEN {_poly_sql(lo, C.C)} / {_poly_sql(lo, C.D)} WHEN {u} > 0.97575 THEN -({_poly_sql(hi, C.C)} / {_poly_sql(hi, C.D)}) ELSE {_poly_sql(f'({q} * {q})', C.A)} * {q} / {_poly_sql(f'({q} * {q})', C.B)} END"


@query(
    "service_draws",
    f"""WITH u AS (SELECT c_custkey AS k, greatest({_U.format("'3|' || c_custkey || '|service'")}, 1e-12) AS u, 1 + c_nationkey / CAST(10 AS DOUBLE) AS m FROM customer)
SELECT k, round({_inverse_sql('u')}, 6) AS z, round(-m * ln(1 - u), 6) AS exponential, round(m * exp(CAST(0.8 AS DOUBLE) * ({_inverse_sql('u')}) - 0.32), 5) AS lognormal, round(m * CAST(1.5 AS DOUBLE) / 2.5 * pow(1 - u, CAST(-0.4 AS DOUBLE)), 5) AS pareto FROM u""",
)
def service_draws(t):
    u, m = C.uniform("3", F.col("c_custkey"), "service"), 1 + F.col("c_nationkey") / 10
    law = lambda name, d: C.service_time(name, m, d, u)
    out = t.customer.select(F.col("c_custkey").alias("k"), C.inverse_normal(u).alias("z"), law("exponential", 0.0).alias("exponential"), law("lognormal", 0.8).alias("lognormal"), law("pareto", 2.5).alias("pareto"))
    return rounded(rounded(out, "z", "exponential"), "lognormal", "pareto", places=5)


@query("cost_ratio", "WITH r AS (SELECT l_returnflag AS g, l_extendedprice / nullif(l_quantity * 1500 - 15000, 0) AS ratio, l_quantity * 1500 - 15000 AS p FROM lineitem) SELECT g, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM r WHERE p > 0 GROUP BY g")
def cost_ratio(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), "l_extendedprice", (F.col("l_quantity") * 1500 - 15000).alias("p"))
    return rounded(C.cost_ratio(rows, "g", "l_extendedprice", "p"), "mean_ratio", "median_ratio")
