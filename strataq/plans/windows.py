"""Ordered-sequence operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import day, epoch, r6
from .base import query
from .scoring import rounded

_D = "d AS (SELECT event_type AS k, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(t):
    return t.events.groupBy(F.col("event_type").alias("k"), day("ts").alias("t")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))


_WIN = "(PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_MOM = f"m AS (SELECT k, t, count(v) OVER {_WIN} AS c, avg(v) OVER {_WIN} AS a, avg(v * v) OVER {_WIN} AS b, avg(v * v * v) OVER {_WIN} AS e FROM d)"


@query("rolling_variance", f"WITH {_D}, {_MOM} SELECT k, t, round(greatest(0, b - a * a) * 7 / 6, 4) AS variance FROM m WHERE c = 7")
def rolling_variance(t):
    return W.rolling(daily(t), "k", ["t"], "v", 7).select("k", "t", F.round("variance", 4).alias("variance"))


@query("rolling_skew", f"WITH {_D}, {_MOM} SELECT k, t, round((e - 3 * a * b + 2 * a * a * a) / nullif(pow(greatest(0, b - a * a), 1.5), 0), 5) AS skewness FROM m WHERE c = 7")
def rolling_skew(t):
    return W.rolling(daily(t), "k", ["t"], "v", 7).select("k", "t", (F.round("skewness", 5) + 0.0).alias("skewness"))


@query(
    "rolling_acf",
    f"""WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM d), w AS (SELECT a.k, a.t, b.i, b.v, avg(b.v) OVER (PARTITION BY a.k, a.t) AS m, count(*) OVER (PARTITION BY a.k, a.t) AS c FROM r a JOIN r b ON a.k = b.k AND b.i BETWEEN a.i - 6 AND a.i),
x AS (SELECT *, lag(v) OVER (PARTITION BY k, t ORDER BY i) AS p FROM w WHERE c = 7) SELECT k, t, round(sum((v - m) * (p - m)) / nullif(sum((v - m) * (v - m)), 0), 5) AS acf FROM x GROUP BY k, t""",
)
def rolling_acf(t):
    return W.rolling(daily(t), "k", ["t"], "v", 7).select("k", "t", (F.round("acf", 5) + 0.0).alias("acf"))


@query(
    "kendall_tau",
    f"""WITH {_D}, p AS (SELECT a.k, sign(a.v - b.v) * sign(a.t - b.t) AS s, CASE WHEN a.v = b.v THEN 1 ELSE 0 END AS tie FROM d a JOIN d b ON a.k = b.k AND a.t > b.t)
SELECT k, round(sum(s) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) - sum(tie))), 6) AS tau, CAST((SELECT count(*) FROM d z WHERE z.k = p.k) AS BIGINT) AS n FROM p GROUP BY k""",
)
def kendall_tau(t):
    return rounded(W.kendall(daily(t), "k", "t", "v"), "tau")


@query(
    "best_change_point",
    f"""WITH {_D}, s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) AS i, count(*) OVER (PARTITION BY k) AS m, sum(v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS s, sum(v * v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS q, sum(v) OVER (PARTITION BY k) AS ts, sum(v * v) OVER (PARTITION BY k) AS tq FROM d),
r AS (SELECT *, round(q - s * s / i + tq - q - (ts - s) * (ts - s) / (m - i), 6) AS rss FROM s WHERE i >= 5 AND m - i >= 5), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rss, i) AS z FROM r)
SELECT k, i AS split_at, round(rss, 2) AS rss, round(tq - ts * ts / m - rss, 2) AS gain FROM o WHERE z = 1""",
)
def best_change_point(t):
    return rounded(W.best_split(daily(t), "k", ["t"], "v", 5).withColumn("split_at", F.col("split_at").cast("long")), "rss", "gain", places=2)


@query("regime_segments")  # a greedy loop: tested against brute force
def regime_segments(t):
    return rounded(W.regime_segments(daily(t), "k", ["t"], "v"), "mean")


_PH = "p AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events), q AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM p)"


@query("phases", f"WITH {_PH} SELECT user_id, CAST(phase AS BIGINT) AS phase, event_type, CAST(min(event_id) AS BIGINT) AS first_event, CAST(max(event_id) AS BIGINT) AS last_event, count(*) AS length FROM q GROUP BY 1, 2, 3")
def phases(t):
    out = W.phases(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", "phase", "event_type", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "length")


@query(
    "runs_test",
    """WITH r AS (SELECT user_id, ts, event_id, sign(value - 50) AS s FROM events WHERE value <> 50), c AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS b FROM r),
g AS (SELECT user_id, sum(b) AS runs, CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS z FROM c GROUP BY 1 HAVING count(*) >= 8)
SELECT user_id, CAST(runs AS BIGINT) AS runs, CAST(a AS BIGINT) AS pos, CAST(z AS BIGINT) AS neg, round((runs - (2 * a * z / (a + z) + 1)) / sqrt(nullif(2 * a * z * (2 * a * z - a - z) / ((a + z) * (a + z) * (a + z - 1)), 0)), 6) AS z FROM g""",
)
def runs_test(t):
    return rounded(W.runs_test(t.events.withColumn("r", F.col("value") - 50), "user_id", ["ts", "event_id"], "r"), "z")


@query(
    "ljung_box",
    f"""WITH {_D}, c AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS c, count(*) OVER (PARTITION BY k) AS n FROM d), l AS (SELECT k, n, c, lag(c, 1) OVER (PARTITION BY k ORDER BY t) AS a, lag(c, 2) OVER (PARTITION BY k ORDER BY t) AS b, lag(c, 3) OVER (PARTITION BY k ORDER BY t) AS e FROM c)
SELECT k, max(n) AS n, round(max(n) * (max(n) + 2) * (pow(sum(c * a) / sum(c * c), 2) / (max(n) - 1) + pow(sum(c * b) / sum(c * c), 2) / (max(n) - 2) + pow(sum(c * e) / sum(c * c), 2) / (max(n) - 3)), 6) AS q FROM l GROUP BY k""",
)
def ljung_box(t):
    return rounded(W.ljung_box(daily(t), "k", ["t"], "v", 3), "q")


@query(
    "rate_jump",
    f"WITH {_D}, j AS (SELECT k, t, avg(n) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c, avg(n) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, count(*) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS e FROM d) SELECT k, t, round(a - b, 6) AS jump FROM j WHERE c >= 6 AND e >= 5",
)
def rate_jump(t):
    w = Window.partitionBy("k").orderBy("t")
    before, after = w.rowsBetween(-6, -1), w.rowsBetween(0, 4)
    j = daily(t).withColumns({"b": F.avg("n").over(before), "c": F.count("*").over(before), "a": F.avg("n").over(after), "e": F.count("*").over(after)})
    return j.where("c >= 6 AND e >= 5").select("k", "t", r6(F.col("a") - F.col("b")).alias("jump"))


@query("ewma", f"WITH {_D} SELECT k, round(sum(n * pow(CAST(0.94 AS DOUBLE), 19753 - t)) / sum(pow(CAST(0.94 AS DOUBLE), 19753 - t)), 6) AS ewma, count(*) AS n FROM d WHERE n >= 55 GROUP BY k")
def ewma(t):
    return rounded(W.ewma(daily(t), "k", ["t"], "n", F.lit(19753) - F.col("t"), F.col("n") >= 55), "ewma")


@query(
    "msprt",
    """WITH e AS (SELECT event_type AS k, event_id, value - 50 AS x FROM events), r AS (SELECT k, event_id, count(*) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i, avg(x) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM e),
l AS (SELECT k, i, m, 0.5 * ln(CAST(2500 AS DOUBLE) / (2500 + i * 25)) + CAST(i AS DOUBLE) * i * 25 * m * m / (2 * CAST(2500 AS DOUBLE) * (2500 + i * 25)) AS llr FROM r), p AS (SELECT k, i, m, least(1, exp(-max(llr) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))) AS p FROM l)
SELECT k, max(i) AS n, round(min(p), 6) AS p, min(CASE WHEN p <= CAST(0.2 AS DOUBLE) THEN i END) AS crossed_at, round(max_by(m, i), 6) AS mean FROM p GROUP BY k""",
)
def msprt(t):
    e = t.events.select(F.col("event_type").alias("k"), "event_id", (F.col("value") - 50).alias("x")).withColumnRenamed("k", "series")
    out = W.mixture_sprt(e, "series", ["event_id"], "x", 50.0, 5.0, 0.2)
    return rounded(out.withColumnRenamed("series", "k"), "p", "mean")


@query("last_k_per_kind", "SELECT event_type, user_id, event_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def last_k_per_kind(t):
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 3").select("event_type", "user_id", "event_id", "k")


@query(
    "crowding_distance",
    """WITH w AS (SELECT p_brand, p_partkey, lag(p_retailprice) OVER a AS al, lead(p_retailprice) OVER a AS ah, lag(p_size) OVER b AS bl, lead(p_size) OVER b AS bh, max(p_retailprice) OVER g - min(p_retailprice) OVER g AS ra, max(p_size) OVER g - min(p_size) OVER g AS rb FROM part
 WINDOW a AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), g AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, CASE WHEN al IS NOT NULL AND ah IS NOT NULL AND bl IS NOT NULL AND bh IS NOT NULL THEN round(coalesce((ah - al) / nullif(ra, 0), 0) + coalesce((bh - bl) / CAST(nullif(rb, 0) AS DOUBLE), 0), 6) END AS crowding FROM w""",
)
def crowding_distance(t):
    return rounded(W.crowding(t.part, "p_brand", ["p_retailprice", "p_size"], "p_partkey").select("p_brand", "p_partkey", "crowding"), "crowding")


@query("delay_embed", f"WITH {_D}, e AS (SELECT k, t, v AS x0, lead(v, 2) OVER (PARTITION BY k ORDER BY t) AS x1, lead(v, 4) OVER (PARTITION BY k ORDER BY t) AS x2 FROM d) SELECT k, t, round(x0, 4) AS x0, round(x1, 4) AS x1, round(x2, 4) AS x2 FROM e WHERE x2 IS NOT NULL")
def delay_embed(t):
    w = Window.partitionBy("k").orderBy("t")
    e = daily(t).select("k", "t", F.col("v").alias("x0"), F.lead("v", 2).over(w).alias("x1"), F.lead("v", 4).over(w).alias("x2"))
    return rounded(e.where("x2 IS NOT NULL"), "x0", "x1", "x2", places=4)


@query(
    "finite_difference",
    """WITH e AS (SELECT user_id, event_id, epoch(ts) / 3600 AS t, value AS x FROM events), n AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, lag(x) OVER w AS p, lead(x) OVER w AS q FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, event_id, round(coalesce(((x - p) / a * b + (q - x) / b * a) / (a + b), (q - x) / b, (x - p) / a), 4) AS slope FROM n""",
)
def finite_difference(t):
    e = t.events.select("user_id", "event_id", (epoch("ts") / 3600).alias("t"), F.col("value").alias("x"))
    return rounded(W.gradient(e, "user_id", "t", "x").select("user_id", "event_id", "slope"), "slope", places=4)


@query(
    "isotonic",
    """WITH g AS (SELECT l_suppkey AS k, l_linenumber AS t, avg(l_discount) AS raw, count(*) AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT a.k, a.t AS lo, b.t AS hi, sum(c.raw * c.w) / sum(c.w) AS m FROM g a JOIN g b ON a.k = b.k AND a.t <= b.t JOIN g c ON c.k = a.k AND c.t BETWEEN a.t AND b.t GROUP BY 1, 2, 3),
u AS (SELECT g.k, g.t, s.hi, min(s.m) AS m FROM g JOIN s ON s.k = g.k AND s.lo <= g.t AND s.hi >= g.t GROUP BY 1, 2, 3)
SELECT k, CAST(t AS INTEGER) AS t, round(max(m), 6) AS fit FROM u GROUP BY k, t""",
)
def isotonic(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("t"), "l_discount")
    return rounded(W.isotonic(rows, "k", "t", "l_discount").select("k", "t", "fit"), "fit")


_C = "c AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events)"


@query("zero_crossings", f"WITH {_C}, l AS (SELECT user_id, sign(c) AS s, lag(sign(c)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM c) SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN s * p < 0 THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM l GROUP BY 1")
def zero_crossings(t):
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a value may be the mean itself, so the order of the sum decides its sign: that of time, as in the files
    e = t.events.select("user_id", "ts", "event_id", "value", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    s = e.select("user_id", "ts", "event_id", F.signum(F.col("value") - F.last("upto").over(whole) / F.count("value").over(whole)).alias("s"))
    return s.withColumn("p", F.lag("s").over(w)).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("s") * F.col("p") < 0).alias("crossings"))


@query(
    "settling_time",
    f"WITH {_D}, f AS (SELECT k, t, v, last_value(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM d) SELECT k, coalesce(max(CASE WHEN abs(v - z) > CAST(0.1 AS DOUBLE) * abs(z) THEN t END) + 1, min(t)) - min(t) AS settled_after, round(max(v - z), 4) AS overshoot FROM f GROUP BY k",
)
def settling_time(t):
    d = daily(t)
    f = d.join(d.groupBy("k").agg(F.max_by("v", "t").alias("z")), "k")
    out = F.max(F.when(F.abs(F.col("v") - F.col("z")) > 0.1 * F.abs("z"), F.col("t"))) + 1
    return f.groupBy("k").agg((F.coalesce(out, F.min("t")) - F.min("t")).alias("settled_after"), (F.round(F.max(F.col("v") - F.col("z")), 4) + 0.0).alias("overshoot"))


@query("niche_key", "SELECT p_partkey, concat_ws('|', CASE WHEN p_size < 10 THEN '0' WHEN p_size < 25 THEN '1' WHEN p_size < 40 THEN '2' ELSE '3' END, CASE WHEN p_retailprice < 950 THEN '0' WHEN p_retailprice < 1050 THEN '1' ELSE '2' END) AS niche FROM part")
def niche_key(t):
    cut = lambda c, edges: sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string")
    return t.part.select("p_partkey", F.concat_ws("|", cut("p_size", (10, 25, 40)), cut("p_retailprice", (950, 1050))).alias("niche"))


@query("bin_clamp", "SELECT CAST(least(greatest(floor((value - 5) / 10), 0), 9) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CASE WHEN value < 5 OR value >= 105 THEN 1 ELSE 0 END) AS BIGINT) AS clamped FROM events GROUP BY 1")
def bin_clamp(t):
    b = F.least(F.greatest(F.floor((F.col("value") - 5) / 10), F.lit(0)), F.lit(9))
    return t.events.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.count_if((F.col("value") < 5) | (F.col("value") >= 105)).alias("clamped"))


@query("onset", f"WITH {_D}, m AS (SELECT k, quantile_cont(n, 0.5) AS med FROM d GROUP BY 1) SELECT k, min(CASE WHEN n < CAST(0.86 AS DOUBLE) * med THEN t END) AS onset FROM d JOIN m USING (k) GROUP BY k")
def onset(t):
    d = daily(t)
    m = d.groupBy("k").agg(F.percentile("n", F.lit(0.5)).alias("med"))
    return d.join(m, "k").groupBy("k").agg(F.min(F.when(F.col("n") < 0.86 * F.col("med"), F.col("t"))).alias("onset"))
