"""End-to-end baselines of the case packs, on the driver's tables in the roles of theirs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.calibration import shrink_to_base
from ..operators.joins import best_lag
from ..operators.ordered import quantiles
from ..operators.windows import isotonic
from ..session import day, epoch
from .base import query
from .joins import daily
from .scoring import rounded

_DAY = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


@query(
    "case_recession",
    f"""WITH q AS (SELECT event_type AS g, {_DAY} AS d, sum(value) AS q FROM events GROUP BY 1, 2), f AS (SELECT {_DAY} + 1 AS d, count(*) AS rain FROM events WHERE event_type = 'error' GROUP BY 1), r AS (SELECT q.g, q.q / lag(q.q) OVER (PARTITION BY q.g ORDER BY q.d) AS ratio, q.d - lag(q.d) OVER (PARTITION BY q.g ORDER BY q.d) AS step, coalesce(f.rain, 0) AS rain FROM q LEFT JOIN f ON f.d = q.d)
SELECT g, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS recession FROM r WHERE step = 1 AND rain < 8 GROUP BY g""",
)
def case_recession(t):
    """Median ratio of successive days without rain; the forcing's day closes one day late."""
    q = t.events.groupBy(F.col("event_type").alias("g"), day("ts").alias("d")).agg(F.sum("value").alias("q"))
    rain = t.events.where("event_type = 'error'").groupBy((day("ts") + 1).alias("d")).agg(F.count("*").alias("rain"))
    w = Window.partitionBy("g").orderBy("d")  # one row per day
    r = q.join(rain, "d", "left").select("g", (F.col("q") / F.lag("q").over(w)).alias("ratio"), (F.col("d") - F.lag("d").over(w)).alias("step"), F.coalesce("rain", F.lit(0)).alias("rain")).where("step = 1 AND rain < 8")
    return rounded(r.groupBy("g").agg(F.count("*").alias("n")).join(quantiles(r, "ratio", {"recession": 0.5}, ["g"]), "g"), "recession")


@query(
    "case_fixed_effects",
    """WITH s AS (SELECT o_custkey AS county, year(o_orderdate) AS season, sum(o_totalprice) / 1000 AS y, count(*) AS x FROM orders GROUP BY 1, 2), m AS (SELECT county, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1), d AS (SELECT x - mx AS x, y - my AS y, s.y AS raw FROM s JOIN m USING (county)), b AS (SELECT sum(x * y) / sum(x * x) AS slope, count(*) AS n, avg(raw) AS level FROM d)
SELECT round(slope, 6) AS slope, n, round((SELECT avg(CASE WHEN y - slope * x < -0.3 * level THEN 1.0 ELSE 0.0 END) FROM d), 6) AS severe_loss FROM b""",
)
def case_fixed_effects(t):
    """Season totals against counts inside counties: demeaned normal equations, then the share far below."""
    s = t.orders.groupBy(F.col("o_custkey").alias("county"), F.year("o_orderdate").alias("season")).agg((F.sum("o_totalprice") / 1000).alias("y"), F.count("*").alias("x"))
    m = s.groupBy("county").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n > 1")
    d = s.join(m, "county").select((F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("dy"), "y")
    b = d.agg((F.sum(F.col("x") * F.col("dy")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.count("*").alias("n"), F.avg("y").alias("level"))  # one row
    low = F.avg(F.when(F.col("dy") - F.col("slope") * F.col("x") < -0.3 * F.col("level"), 1.0).otherwise(0.0))
    return rounded(d.crossJoin(b).groupBy("slope", "n").agg(low.alias("severe_loss")), "slope", "severe_loss")


@query(
    "case_step_jump",
    f"""WITH d AS (SELECT user_id AS u, {_DAY} AS d, sum(value) AS v FROM events GROUP BY 1, 2), j AS (SELECT u, d, avg(v) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN 0 FOLLOWING AND 4 FOLLOWING) - avg(v) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS jump, row_number() OVER (PARTITION BY u ORDER BY d) AS i, count(*) OVER (PARTITION BY u) AS n FROM d),
b AS (SELECT u, arg_min(d, {{'a': -round(jump, 6), 'b': d}}) AS at, max(round(jump, 6)) AS jump FROM j WHERE i > 6 AND i <= n - 4 GROUP BY u)
SELECT b.u, b.at, b.jump, c.at - b.at AS neighbour_lag, c.at > b.at AS follows FROM b LEFT JOIN b c ON c.u = b.u + 1""",
)
def case_step_jump(t):
    """Largest before/after jump of every user, and the lag to the jump of the next."""
    d = t.events.groupBy(F.col("user_id").alias("u"), day("ts").alias("d")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("u").orderBy("d")
    jump = F.round(F.avg("v").over(w.rowsBetween(0, 4)) - F.avg("v").over(w.rowsBetween(-6, -1)), 6) + 0.0
    j = d.select("u", "d", jump.alias("jump"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("u")).alias("n")).where("i > 6 AND i <= n - 4")
    b = j.groupBy("u").agg(F.min_by("d", F.struct(-F.col("jump"), F.col("d"))).alias("at"), F.max("jump").alias("jump"))
    c = b.select((F.col("u") - 1).alias("u"), F.col("at").alias("next"))
    return b.join(c, "u", "left").select("u", "at", "jump", (F.col("next") - F.col("at")).alias("neighbour_lag"), (F.col("next") > F.col("at")).alias("follows"))


@query(
    "case_coupling",
    """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, CAST(floor((epoch(l_shipdate) / 86400 + CASE WHEN l_suppkey % 2 = 0 THEN 7 ELSE 0 END) / 7) AS BIGINT) AS week FROM lineitem), r AS (SELECT s, week, count(*) AS links FROM l WHERE week % 11 <> 0 GROUP BY 1, 2), e AS (SELECT max(week) AS z FROM l)
SELECT s, round(sum(links * pow(CAST(0.94 AS DOUBLE), z - week)) / sum(pow(CAST(0.94 AS DOUBLE), z - week)), 6) AS rate, CAST(sum(links) AS BIGINT) AS links, count(*) AS weeks FROM r, e GROUP BY s""",
)
def case_coupling(t):
    """Repeated links count once, one shard reports a week late, outage weeks are out; exponentially weighted rate."""
    week = F.floor((epoch("l_shipdate") / 86400 + F.when(F.col("l_suppkey") % 2 == 0, 7).otherwise(0)) / 7)
    links = t.lineitem.select(F.col("l_suppkey").alias("s"), "l_partkey", week.alias("week")).distinct()
    last = links.agg(F.max("week").alias("z"))  # one row
    r = links.where("week % 11 <> 0").groupBy("s", "week").agg(F.count("*").alias("links")).crossJoin(last)
    weight = F.pow(F.lit(0.94), F.col("z") - F.col("week"))
    return rounded(r.groupBy("s").agg((F.sum(F.col("links") * weight) / F.sum(weight)).alias("rate"), F.sum("links").alias("links"), F.count("*").alias("weeks")), "rate")


@query(
    "case_tip_risk",
    """WITH f AS (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS fleet FROM events) SELECT user_id AS station, count(*) AS n, round((sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) + 4 * max(fleet)) / (count(*) + 4), 6) AS tip_rate, round(avg(CASE WHEN event_type = 'error' THEN hour(ts) END), 6) AS mean_hour, round(avg(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN -1.0 ELSE 0.0 END), 6) AS net_flow FROM events, f GROUP BY 1""",
)
def case_tip_risk(t):
    """Shrunken tip rate, mean hour of a tip and mean net flow of every station."""
    e, tip = F.col("event_type"), F.col("event_type") == "error"
    g = t.events.groupBy(F.col("user_id").alias("station")).agg(F.count("*").alias("n"), F.count_if(tip).alias("tips"), F.avg(F.when(tip, F.hour("ts"))).alias("mean_hour"), F.avg(F.when(e == "click", 1.0).when(e == "view", -1.0).otherwise(0.0)).alias("net_flow"))
    fleet = g.agg((F.sum("tips") / F.sum("n")).alias("fleet"))  # one row
    return rounded(g.crossJoin(fleet).select("station", "n", ((F.col("tips") + 4 * F.col("fleet")) / (F.col("n") + 4)).alias("tip_rate"), "mean_hour", "net_flow"), "tip_rate", "mean_hour", "net_flow")


@query(
    "case_origin_sensor",
    f"""WITH d AS (SELECT event_type AS g, {_DAY} AS t, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), m AS (SELECT g, 0.86 * quantile_cont(v, 0.5) AS cut FROM d GROUP BY g), o AS (SELECT d.g, min(CASE WHEN v < cut THEN t END) AS onset FROM d JOIN m USING (g) GROUP BY 1),
p AS (SELECT b.g, b.t - a.t AS lag, a.v AS x, b.v AS y FROM d a JOIN d b ON b.t - a.t BETWEEN -5 AND 5 WHERE a.g = 'click' AND b.g <> 'click'), c AS (SELECT g, lag, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) AS sx, sqrt(greatest(0, avg(y * y) - avg(y) * avg(y))) AS sy, avg(x * y) AS mxy FROM p GROUP BY 1, 2),
r AS (SELECT g, lag, round((mxy - mx * my) / (sx * sy), 6) AS r FROM c WHERE n >= 12 AND sx > 1e-6 AND sy > 1e-6), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY r DESC, lag) = 1)
SELECT o.g AS sensor, o.onset, b.lag, b.r, o.onset = (SELECT min(onset) FROM o) AS is_origin FROM o LEFT JOIN b USING (g)""",
)
def case_origin_sensor(t):
    """Onset below 0.86 of the median, best lag to one sensor, and the sensor where it began."""
    d = daily(t)
    cut = quantiles(d, "v", {"m": 0.5}, ["series"])
    o = d.join(cut, "series").groupBy("series").agg(F.min(F.when(F.col("v") < 0.86 * F.col("m"), F.col("t"))).alias("onset"))
    first = o.agg(F.min("onset").alias("first"))  # one row
    return o.join(best_lag(d, "click").select("series", "lag", "r"), "series", "left").crossJoin(first).select(F.col("series").alias("sensor"), "onset", "lag", "r", (F.col("onset") == F.col("first")).alias("is_origin"))


@query(
    "case_thin_quotes",
    """WITH r AS (SELECT l_orderkey AS e, l_returnflag AS category, l_discount * 10 AS p, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 60 ELSE l_quantity END AS age, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_quantity END AS volume, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)
SELECT category, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(age), 4) AS mean_age_seconds, round(avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END), 6) AS suppressed, round(avg(ln(1 + age) - ln(1 + coalesce(volume, 0))), 6) AS thinness FROM r GROUP BY 1""",
)
def case_thin_quotes(t):
    """Quote ages in one unit, suppressed volumes counted, and a thinness score by category."""
    age = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 60).otherwise(F.col("l_quantity"))
    y, volume = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0), F.when(F.col("l_tax") > 0.06, None).otherwise(F.col("l_quantity"))
    out = t.lineitem.groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.avg((F.col("l_discount") * 10 - y) ** 2).alias("brier"), F.avg(age).alias("mean_age_seconds"), F.avg(F.when(volume.isNull(), 1.0).otherwise(0.0)).alias("suppressed"), F.avg(F.log(1 + age) - F.log(1 + F.coalesce(volume, F.lit(0)))).alias("thinness"))
    return rounded(rounded(out, "brier", "suppressed", "thinness"), "mean_age_seconds", places=4)


@query(
    "case_ladder",
    """WITH r AS (SELECT l_suppkey AS k, l_linenumber AS t, l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END AS y, l_shipdate < DATE '1996-01-01' AS train FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1), b AS (SELECT avg(y) AS base FROM r WHERE train), a AS (SELECT base, least(1, greatest(0, sum((y - p) * (base - p)) / sum((base - p) * (base - p)))) AS alpha FROM r, b WHERE train GROUP BY base),
c AS (SELECT k, t, y, p + alpha * (base - p) AS p FROM r, a WHERE NOT train), g AS (SELECT k, t, avg(p) AS raw, count(*) AS w FROM c GROUP BY 1, 2), s AS (SELECT x.k, x.t AS lo, z.t AS hi, sum(m.raw * m.w) / sum(m.w) AS m FROM g x JOIN g z ON x.k = z.k AND x.t <= z.t JOIN g m ON m.k = x.k AND m.t BETWEEN x.t AND z.t GROUP BY 1, 2, 3),
u AS (SELECT g.k, g.t, s.hi, min(s.m) AS m FROM g JOIN s ON s.k = g.k AND s.lo <= g.t AND s.hi >= g.t GROUP BY 1, 2, 3), f AS (SELECT k, t, max(m) AS fit FROM u GROUP BY 1, 2), q AS (SELECT c.k, avg(pow(p - y, 2)) AS plain, avg(pow(fit - y, 2)) AS fitted, count(*) AS n FROM c JOIN f ON f.k = c.k AND f.t = c.t GROUP BY 1), v AS (SELECT count(*) AS violations FROM (SELECT raw, lag(raw) OVER (PARTITION BY k ORDER BY t) AS prev FROM g) WHERE raw > prev + 1e-9)
SELECT round(base, 6) AS base, round(alpha, 6) AS alpha, round(avg(plain), 6) AS brier_calibrated, round(avg(fitted), 6) AS brier_coherent, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, max(violations) AS violations FROM q, a, v GROUP BY base, alpha""",
)
def case_ladder(t):
    """Prices of a ladder of thresholds: calibrated on the early split, made coherent, scored by group.

    A ladder is a supplier, a threshold a line number; a price that rises with its threshold is a violation.
    """
    r = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("t"), (F.col("l_discount") * 10).alias("p"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("date")).alias("train")).where("p BETWEEN 0 AND 1")
    fit = shrink_to_base(r.where("train"), "p", "y")  # one row
    c = r.where("NOT train").crossJoin(fit).select("k", "t", "y", (F.col("p") + F.col("alpha") * (F.col("base") - F.col("p"))).alias("p"))
    ladder = isotonic(c, "k", "t", "p")
    rise = (F.col("raw") > F.lag("raw").over(Window.partitionBy("k").orderBy("t")) + 1e-9).cast("int")  # one row per threshold
    violations = ladder.select(rise.alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("violations"))
    per = c.join(ladder.select("k", "t", "fit"), ["k", "t"]).groupBy("k").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("plain"), F.avg((F.col("fit") - F.col("y")) ** 2).alias("fitted"), F.count("*").alias("n"))
    total = per.agg(F.avg("plain").alias("brier_calibrated"), F.avg("fitted").alias("brier_coherent"), F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))
    return rounded(fit.crossJoin(total).crossJoin(violations), "base", "alpha", "brier_calibrated", "brier_coherent")
