"""Scores, calibration and grouped reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import scoring as S
from ..session import day, epoch, r6
from .base import query

_SC = "s AS (SELECT d.doc_id, d.source AS g, CAST(l.quality AS DOUBLE) AS y, 1 / (1 + exp(-(ln(d.n_chars) - 6.5) * 0.5)) AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
_LL = "-(y * ln(least(greatest(p, {c}), 1 - {c})) + (1 - y) * ln(1 - least(greatest(p, {c}), 1 - {c})))".format(c="CAST(1e-12 AS DOUBLE)")


def forecasts(t):
    p = 1 / (1 + F.exp(-(F.log("n_chars") - 6.5) * 0.5))
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.col("source").alias("g"), F.col("quality").cast("double").alias("y"), p.alias("p"))


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in cols})


@query("grouped_brier", f"WITH {_SC}, g AS (SELECT g, avg((p - y) * (p - y)) AS b, sum({_LL}) AS l, count(*) AS n FROM s GROUP BY g) SELECT round(avg(b), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g")
def grouped_brier(t):
    return rounded(S.grouped_brier(forecasts(t), "g"), "brier", "log_loss")


_BINS = "b AS (SELECT CAST(least(floor(p * {n}), {n} - 1) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM s GROUP BY 1)"


@query("reliability_bins", f"WITH {_SC}, {_BINS.format(n=5)} SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM (SELECT unnest(range(5)) AS bin) r LEFT JOIN b ON b.bin = r.bin")
def reliability_bins(t):
    return rounded(S.reliability(forecasts(t), 5), "mean_p", "mean_y")


@query(
    "murphy_decomposition",
    f"""WITH {_SC}, {_BINS.format(n=10)}, a AS (SELECT sum(n) AS m, sum(n * mean_y) / sum(n) AS base FROM b)
SELECT round(sum(n / CAST(m AS DOUBLE) * abs(mean_p - mean_y)), 6) AS ece, round(max(abs(mean_p - mean_y)), 6) AS mce, round(sum(n / CAST(m AS DOUBLE) * (mean_p - mean_y) * (mean_p - mean_y)), 6) AS reliability,
 round(sum(n / CAST(m AS DOUBLE) * (mean_y - base) * (mean_y - base)), 6) AS resolution, round(min(base * (1 - base)), 6) AS uncertainty, count(*) AS occupied FROM b, a""",
)
def murphy_decomposition(t):
    return rounded(S.murphy(forecasts(t)), "ece", "mce", "reliability", "resolution", "uncertainty")


@query(
    "crps",
    """WITH e AS (SELECT l_orderkey AS obs, l_quantity AS x, o_totalprice / 10000 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT obs, round(sum(abs(x - y) / m - (2 * i - m - 1) * x / CAST(m * m AS DOUBLE)), 9) AS crps FROM e GROUP BY obs""",
)
def crps(t):
    e = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("obs"), F.col("l_quantity").alias("x"), (F.col("o_totalprice") / 10000).alias("y"))
    return rounded(S.crps(e, "obs", "x", "y"), "crps", places=9)


@query(
    "interval_score",
    """WITH i AS (SELECT l_returnflag AS g, l_quantity AS y, 5 + 100 * l_discount AS lo, 40 + 100 * l_tax AS hi FROM lineitem)
SELECT g, round(avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0))), 6) AS score, round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(hi - lo), 6) AS sharpness, CAST(sum(CASE WHEN y < lo OR y > hi THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM i GROUP BY g""",
)
def interval_score(t):
    y, lo, hi = F.col("l_quantity"), 5 + 100 * F.col("l_discount"), 40 + 100 * F.col("l_tax")
    inside = (y >= lo) & (y <= hi)
    out = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(F.avg(S.interval_score(lo, hi, y, 0.1)).alias("score"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("coverage"), F.avg(hi - lo).alias("sharpness"), F.count_if(~inside).alias("misses"))
    return rounded(out, "score", "coverage", "sharpness")


@query("loss_suite", f"WITH {_SC} SELECT g, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_LL.replace('1e-12', '1e-9')}), 6) AS log_loss, round(avg(abs(p - y)), 6) AS absolute, round(abs(avg(p) - avg(y)), 6) AS total_variation FROM s GROUP BY g")
def loss_suite(t):
    p, y = F.col("p"), F.col("y")
    out = forecasts(t).groupBy("g").agg(F.count("*").alias("n"), F.avg((p - y) ** 2).alias("brier"), F.avg(S.log_loss(p, y, 1e-9)).alias("log_loss"), F.avg(F.abs(p - y)).alias("absolute"), F.abs(F.avg(p) - F.avg(y)).alias("total_variation"))
    return rounded(out, "brier", "log_loss", "absolute", "total_variation")


@query(
    "rank_auc",
    f"""WITH {_SC}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / CAST(2 AS DOUBLE) AS k FROM s)
SELECT round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc, CAST(sum(y) AS BIGINT) AS positives, count(*) AS n_rows FROM r""",
)
def rank_auc(t):
    return rounded(S.rank_auc(forecasts(t)), "auc")


@query(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / CAST(2 AS DOUBLE) AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n_rows FROM r""",
)
def spearman(t):
    return rounded(S.spearman(t.lineitem, "l_quantity", "l_discount"), "rho")


@query("quantiles", "SELECT event_type, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY event_type")
def quantiles(t):
    return rounded(O.quantiles(t.events, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["event_type"]), "p10", "p50", "p90", places=4)


@query("tail_report", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS worst, round(quantile_cont(value, 0.99) / avg(value), 4) AS tail_ratio FROM events GROUP BY event_type")
def tail_report(t):
    return rounded(S.tail_report(t.events, "event_type", "value"), "mean", "p50", "p95", "p99", "tail_ratio", places=4)


@query("cvar", "SELECT event_type, round(avg(value), 6) AS cvar, count(*) AS n_tail FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k > floor(n * CAST(0.9 AS DOUBLE)) GROUP BY event_type")
def cvar(t):
    return rounded(S.cvar(t.events, "event_type", "value"), "cvar")


@query("quantile_fan", "SELECT CAST(l_linenumber AS BIGINT) AS idx, round(quantile_cont(l_extendedprice, 0.05), 2) AS lo, round(quantile_cont(l_extendedprice, 0.5), 2) AS mid, round(quantile_cont(l_extendedprice, 0.95), 2) AS hi FROM lineitem GROUP BY l_linenumber")
def quantile_fan(t):
    rows = t.lineitem.select(F.col("l_linenumber").cast("long").alias("idx"), "l_extendedprice")
    return rounded(O.quantiles(rows, "l_extendedprice", {"lo": 0.05, "mid": 0.5, "hi": 0.95}, ["idx"]), "lo", "mid", "hi", places=2)


@query(
    "scenario_summary",
    """WITH m AS (SELECT o_orderpriority AS arm, date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS rep, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.arm, round(avg(a.v), 2) AS mean_utility, round(quantile_cont(a.v, 0.1), 2) AS p10, round(quantile_cont(a.v, 0.9), 2) AS p90, round(avg(a.v - b.v), 2) AS difference FROM m a LEFT JOIN m b ON a.rep = b.rep AND b.arm = '1-URGENT' GROUP BY a.arm""",
)
def scenario_summary(t):
    d = F.col("o_orderdate").cast("date")
    m = t.orders.groupBy(F.col("o_orderpriority").alias("arm"), ((F.year(d) - 1995) * 12 + F.month(d) - 1).alias("rep")).agg(F.avg("o_totalprice").alias("v"))
    base = m.where("arm = '1-URGENT'").select("rep", F.col("v").alias("b"))
    out = m.join(base, "rep", "left").groupBy("arm").agg(F.avg("v").alias("mean_utility"), F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.9)).alias("p90"), F.avg(F.col("v") - F.col("b")).alias("difference"))
    return rounded(out, "mean_utility", "p10", "p90", "difference", places=2)


_HITS = "SELECT o_orderpriority AS tool, count(*) AS attempts, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS unscorable, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS scored, CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS hits"


@query("hit_rates", f"SELECT *, round(hits / CAST(nullif(scored, 0) AS DOUBLE), 6) AS hit_rate FROM ({_HITS} FROM orders GROUP BY 1)")
def hit_rates(t):
    s = F.col("o_orderstatus")
    out = t.orders.groupBy(F.col("o_orderpriority").alias("tool")).agg(F.count("*").alias("attempts"), F.count_if(s == "P").alias("pending"), F.count_if(s == "O").alias("unscorable"), F.count_if(s == "F").alias("scored"), F.count_if((s == "F") & (F.col("o_totalprice") > 250000)).alias("hits"))
    return out.withColumn("hit_rate", r6(F.col("hits") / F.nullif("scored", F.lit(0))))


@query("unresolved_pairs", "SELECT o_custkey, o_orderpriority, count(*) AS attempts FROM orders GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0")
def unresolved_pairs(t):
    out = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("attempts"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    return out.where("attempts >= 3 AND hits = 0").drop("hits")


_TAX = [("failed_step", "event_type = 'error'"), ("costly_step", "value > 150"), ("costly_failure", "event_type = 'error' AND value > 100"), ("free_purchase", "event_type = 'purchase' AND value < 1"), ("idle_view", "event_type = 'view' AND value = 0"), ("large_purchase", "event_type = 'purchase' AND value > 120")]


@query(
    "failure_taxonomy",
    "WITH i AS (" + " UNION ALL ".join(f"SELECT '{k}' AS failure, * FROM events WHERE {c}" for k, c in _TAX) + """), d AS (SELECT failure, event_type, row_number() OVER (PARTITION BY failure ORDER BY count(*) DESC, event_type) AS k FROM i GROUP BY 1, 2)
SELECT i.failure, count(*) AS incidents, count(DISTINCT user_id) AS traces, round(sum(value), 2) AS cost, max(d.event_type) AS dominant_tool, CAST(min(event_id) AS BIGINT) AS exemplar FROM i JOIN d ON d.failure = i.failure AND d.k = 1 GROUP BY i.failure""",
)
def failure_taxonomy(t):
    return S.failure_taxonomy(t.events, dict(_TAX), trace="user_id", tool="event_type", cost="value", step="event_id")


@query("herfindahl", "WITH g AS (SELECT event_type AS family, user_id, sum(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT family, v / sum(v) OVER (PARTITION BY family) AS share FROM g WHERE v > 0) SELECT family, count(*) AS members, round(sum(share * share), 6) AS herfindahl, round(max(share), 6) AS top_share FROM s GROUP BY family")
def herfindahl(t):
    g = t.events.groupBy(F.col("event_type").alias("family"), "user_id").agg(F.sum("value").alias("v")).where("v > 0")
    # sum of squared shares = sum(v^2) / sum(v)^2, which needs no window
    return rounded(g.groupBy("family").agg(F.count("*").alias("members"), (F.sum(F.col("v") ** 2) / F.sum("v") ** 2).alias("herfindahl"), (F.max("v") / F.sum("v")).alias("top_share")), "herfindahl", "top_share")


@query(
    "correlation_drift",
    """WITH d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, event_type AS k, sum(value) AS v FROM events GROUP BY 1, 2),
h AS (SELECT *, ntile(2) OVER (PARTITION BY k ORDER BY t) AS half FROM d),
p AS (SELECT a.k AS left_proxy, b.k AS right_proxy, a.half, corr(a.v, b.v) AS r FROM h a JOIN h b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2, 3)
SELECT left_proxy, right_proxy, round(max(CASE WHEN half = 1 THEN r END), 6) AS early, round(max(CASE WHEN half = 2 THEN r END), 6) AS late, round(max(CASE WHEN half = 2 THEN r END) - max(CASE WHEN half = 1 THEN r END), 6) AS drift FROM p GROUP BY 1, 2""",
)
def correlation_drift(t):
    d = t.events.groupBy(day("ts").alias("t"), F.col("event_type").alias("k")).agg(F.sum("value").alias("v"))
    return rounded(S.correlation_drift(d, "k", "t", "v"), "early", "late", "drift")


@query("severity_mass", "WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders), w AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS s FROM d) SELECT o_orderpriority AS kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS mass, CAST(max(s) AS INTEGER) AS severity FROM w WHERE o_orderstatus <> 'F' GROUP BY 1")
def severity_mass(t):
    s = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 3).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(1)
    return t.orders.where("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderpriority").alias("kind"), "o_orderstatus", s.alias("s")).distinct().groupBy("kind").agg(F.count("*").alias("n"), F.sum("s").alias("mass"), F.max("s").alias("severity"))


_OPEN = "SELECT CASE event_type WHEN 'error' THEN 'fault' WHEN 'view' THEN 'unseen' ELSE 'other' END AS kind, event_type AS tool, round(sum(value), 6) AS mass FROM events GROUP BY 1, 2"
_PAST = "SELECT event_type AS tool, CASE event_type WHEN 'error' THEN 'fault' ELSE 'other' END AS kind, count(*) AS attempts, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS resolutions FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2"
_COST = "SELECT event_type AS tool, greatest(0.1, CAST(min(user_id) AS DOUBLE)) AS cost, 1 + 0.5 * (1 - count(DISTINCT user_id) / CAST(max(count(DISTINCT user_id)) OVER () AS DOUBLE)) AS bonus FROM events GROUP BY 1"


@query(
    "voi_rank",
    f"""WITH o AS ({_OPEN}), h AS ({_PAST}), c AS ({_COST}), s AS (SELECT o.tool, sum(mass * CASE WHEN coalesce(attempts, 0) = 0 THEN CAST(0.25 AS DOUBLE) ELSE resolutions / CAST(attempts AS DOUBLE) END) AS gain, CAST(sum(CASE WHEN coalesce(attempts, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS priors FROM o LEFT JOIN h ON h.tool = o.tool AND h.kind = o.kind GROUP BY 1)
SELECT s.tool, priors, round(gain, 4) AS gain, round(gain / cost * bonus, 4) AS score, CAST(row_number() OVER (ORDER BY round(gain / cost * bonus, 4) DESC, s.tool) AS INTEGER) AS rank FROM s JOIN c ON c.tool = s.tool""",
)
def voi_rank(t):
    e = t.events
    kind = lambda seen: F.when(F.col("event_type") == "error", "fault").when(F.lit(seen) & (F.col("event_type") == "view"), "unseen").otherwise("other")
    open_items = e.groupBy(kind(True).alias("kind"), F.col("event_type").alias("tool")).agg(F.round(F.sum("value"), 6).alias("mass"))
    past = e.where("event_type <> 'purchase'").groupBy(F.col("event_type").alias("tool"), kind(False).alias("kind")).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("resolutions"))
    costs = e.groupBy(F.col("event_type").alias("tool")).agg(F.min("user_id").cast("double").alias("cost"), F.countDistinct("user_id").alias("visits"))
    out = S.voi_rank(open_items, past, costs)
    return out.select("tool", "priors", F.round("gain", 4).alias("gain"), "score", "rank")


@query(
    "ucb1",
    """WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS mean FROM events GROUP BY 1) SELECT arm, n, round(mean, 6) AS mean, round(mean + sqrt(2 * ln((SELECT sum(n) FROM a)) / n), 6) AS ucb FROM a""",
)
def ucb1(t):
    a = t.events.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("mean"))
    total = a.agg(F.sum("n").alias("total"))  # one row
    return rounded(a.crossJoin(total).select("arm", "n", "mean", (F.col("mean") + F.sqrt(2 * F.log("total") / F.col("n"))).alias("ucb")), "mean", "ucb")


@query(
    "decay_credit",
    """WITH e AS (SELECT event_type AS arm, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS hit, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events)
SELECT arm, round(sum(hit * pow(CAST(0.9 AS DOUBLE), age)), 6) AS credit, round(sum(hit * pow(CAST(0.9 AS DOUBLE), age)) / sum(pow(CAST(0.9 AS DOUBLE), age)), 6) AS rate FROM e GROUP BY arm""",
)
def decay_credit(t):
    w = F.pow(F.lit(0.9), F.lit(19753) - day("ts"))  # days up to 2024-01-31
    hit = F.when(F.col("value") > 50, w).otherwise(0.0)
    return rounded(t.events.groupBy(F.col("event_type").alias("arm")).agg(F.sum(hit).alias("credit"), (F.sum(hit) / F.sum(w)).alias("rate")), "credit", "rate")


@query("budget_snapshot", "SELECT o_custkey AS scope, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.9 ELSE o_totalprice END), 2) AS used, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS open_reservations, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.9 ELSE o_totalprice END) > 3000000 AS over_cap FROM orders GROUP BY 1")
def budget_snapshot(t):
    used = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.9).otherwise(F.col("o_totalprice")))
    return t.orders.groupBy(F.col("o_custkey").alias("scope")).agg(F.round(used, 2).alias("used"), F.count_if(F.col("o_orderstatus") != "F").alias("open_reservations"), (used > 3000000).alias("over_cap"))


@query(
    "qd_metrics",
    """WITH c AS (SELECT p_brand, least(floor(p_size / CAST(10 AS DOUBLE)), 4) AS b, max(p_retailprice) AS best, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT sum(n) AS m FROM c)
SELECT count(*) AS cells, round(count(*) / CAST(125 AS DOUBLE), 6) AS coverage, round(sum(best), 2) AS qd_score, round(-sum(n / CAST(m AS DOUBLE) * log2(n / CAST(m AS DOUBLE))), 6) AS entropy FROM c, t""",
)
def qd_metrics(t):
    c = t.part.groupBy("p_brand", F.least(F.floor(F.col("p_size") / 10), F.lit(4)).alias("b")).agg(F.max("p_retailprice").alias("best"), F.count("*").alias("n"))
    # entropy = log2(m) - sum(n log2 n) / m, in one aggregate
    return rounded(c.agg(F.count("*").alias("cells"), (F.count("*") / 125).alias("coverage"), F.sum("best").alias("qd_score"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")), "coverage", "entropy").withColumn("qd_score", F.round("qd_score", 2))


@query("niche_elites", "SELECT p_brand, p_type, p_partkey AS elite, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part) WHERE k = 1")
def niche_elites(t):
    best = F.min_by(F.struct("p_partkey", "p_retailprice"), F.struct(-F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey"))).alias("e")
    return t.part.groupBy("p_brand", "p_type").agg(best).select("p_brand", "p_type", F.col("e.p_partkey").alias("elite"), F.col("e.p_retailprice").alias("p_retailprice"))


_ERR = "SELECT l_quantity, l_extendedprice AS y, l_quantity * 1500 AS f, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 'interior' WHEN l_quantity BETWEEN 5 AND 45 THEN 'boundary' ELSE 'extrapolation' END AS support FROM lineitem"


@query("error_by_support", f"WITH e AS ({_ERR}) SELECT support, count(*) AS n, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae, round(max(abs(y - f)), 4) AS worst, round(avg(f - y), 4) AS bias FROM e GROUP BY support")
def error_by_support(t):
    q, e = F.col("l_quantity"), F.col("l_quantity") * 1500 - F.col("l_extendedprice")
    s = F.when(q.between(10, 40), "interior").when(q.between(5, 45), "boundary").otherwise("extrapolation")
    return rounded(t.lineitem.groupBy(s.alias("support")).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("worst"), F.avg(e).alias("bias")), "rmse", "mae", "worst", "bias", places=4)


@query(
    "binned_residuals",
    """WITH q AS (SELECT [quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75)] AS e FROM lineitem), r AS (SELECT CASE WHEN l_quantity < e[1] THEN 0 WHEN l_quantity < e[2] THEN 1 WHEN l_quantity < e[3] THEN 2 ELSE 3 END AS bin, l_tax - l_discount AS v FROM lineitem, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 4) AS t_stat FROM r GROUP BY bin HAVING count(*) >= 3""",
)
def binned_residuals(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_tax") - F.col("l_discount")).alias("v"))
    return rounded(rounded(S.binned_residuals(rows, "x", "v", bins=4), "mean"), "t_stat", places=4)


@query(
    "mutual_information",
    """WITH p AS (SELECT value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events), q AS (SELECT x, y FROM p WHERE x IS NOT NULL), m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM q),
k AS (SELECT least(floor((x - a) / (b - a) * 8), 7) AS i, least(floor((y - c) / (d - c) * 8), 7) AS j, count(*) AS n FROM q, m GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM k)
SELECT round(sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (CAST(ni AS DOUBLE) * nj))), 6) AS mi, CAST(max(t) AS BIGINT) AS n_pairs FROM w""",
)
def mutual_information(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = t.events.select(F.lag("value").over(w).alias("x"), F.col("value").alias("y")).where("x IS NOT NULL")
    return rounded(S.mutual_information(pairs, "x", "y"), "mi")


_DEG = "g AS (SELECT l_suppkey AS u, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY 1)"


@query("degree_stats", f"WITH {_DEG} SELECT count(*) AS n, round(avg(d), 6) AS mean, round(var_pop(d), 4) AS variance, round(var_pop(d) / avg(d), 6) AS dispersion, CAST(min(d) AS BIGINT) AS least, CAST(max(d) AS BIGINT) AS greatest FROM g")
def degree_stats(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("u")).agg(F.countDistinct("l_partkey").alias("d"))
    out = g.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("variance"), (F.var_pop("d") / F.avg("d")).alias("dispersion"), F.min("d").alias("least"), F.max("d").alias("greatest"))
    return rounded(rounded(out, "mean", "dispersion"), "variance", places=4)


@query("gini", f"WITH {_DEG}, r AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM g) SELECT round(2 * sum(i * d) / (CAST(max(n) AS DOUBLE) * sum(d)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 6) AS gini, max(n) AS n FROM r")
def gini(t):
    return rounded(S.gini(t.lineitem.groupBy(F.col("l_suppkey").alias("u")).agg(F.countDistinct("l_partkey").alias("d")), "d"), "gini")


@query(
    "ari",
    """WITH k AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS x FROM k), ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM k GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM k GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS x FROM k)
SELECT round((s.x - ra.x * rb.x / t.x) / ((ra.x + rb.x) / 2 - ra.x * rb.x / t.x), 8) AS ari FROM s, ra, rb, t""",
)
def ari(t):
    return rounded(S.adjusted_rand(t.orders, "o_orderstatus", "o_orderpriority"), "ari", places=8)


@query(
    "modularity",
    """WITH e AS (SELECT n_nationkey AS u, n_regionkey AS cu, c_mktsegment AS seg, count(*) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3), t AS (SELECT CAST(sum(w) AS DOUBLE) AS m FROM e),
x AS (SELECT cu, seg, sum(w) AS w FROM e GROUP BY 1, 2), r AS (SELECT cu, sum(w) AS w FROM e GROUP BY 1), s AS (SELECT seg, sum(w) AS w FROM e GROUP BY 1), a AS (SELECT cu, seg, row_number() OVER (PARTITION BY cu ORDER BY w DESC, seg) AS k, w FROM x)
SELECT round(sum(a.w / m - r.w * s.w / (m * m)), 6) AS modularity, count(*) AS communities FROM a JOIN r ON r.cu = a.cu JOIN s ON s.seg = a.seg, t WHERE a.k = 1""",
)
def modularity(t):
    """Bipartite region-segment graph; a community is a region with its largest segment."""
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("cu"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("w"))
    r, s, m = x.groupBy("cu").agg(F.sum("w").alias("rw")), x.groupBy("seg").agg(F.sum("w").alias("sw")), x.agg(F.sum("w").cast("double").alias("m"))
    a = x.groupBy("cu").agg(F.min_by(F.struct("seg", "w"), F.struct(-F.col("w"), F.col("seg"))).alias("b")).select("cu", "b.seg", "b.w")
    j = a.join(r, "cu").join(s, "seg").crossJoin(m)
    return rounded(j.agg(F.sum(F.col("w") / F.col("m") - F.col("rw") * F.col("sw") / (F.col("m") * F.col("m"))).alias("modularity"), F.count("*").alias("communities")), "modularity")


@query(
    "token_f1",
    r"""WITH p AS (SELECT a.item_id AS k, a.text AS g, b.text AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
n AS (SELECT k, list_filter(regexp_split_to_array(regexp_replace(lower(g), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS g, list_filter(regexp_split_to_array(regexp_replace(lower(h), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS h FROM p),
x AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(g) AS w FROM n) GROUP BY 1, 2), y AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(h) AS w FROM n) GROUP BY 1, 2), o AS (SELECT x.k, sum(least(x.c, y.c)) AS common FROM x JOIN y ON x.k = y.k AND x.w = y.w GROUP BY 1)
SELECT n.k AS item_id, array_to_string(g, ' ') = array_to_string(h, ' ') AS exact, round(2 * coalesce(common, 0) / CAST(len(g) + len(h) AS DOUBLE), 6) AS f1 FROM n LEFT JOIN o ON o.k = n.k""",
)
def token_f1(t):
    b = t.benchmark
    pairs = b.select("item_id", F.col("text").alias("gold")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("answer")), "item_id")
    return rounded(S.exact_match_f1(pairs, "item_id", "gold", "answer"), "f1")


@query(
    "declared_comparison",
    """WITH m AS (SELECT c_mktsegment AS arm, avg(o_totalprice) AS a, max(o_totalprice) AS b, min(o_totalprice) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), z AS (SELECT * FROM m WHERE arm = 'BUILDING')
SELECT m.arm, round(m.a - z.a, 4) AS delta_mean, round(m.b - z.b, 4) AS delta_max, round(m.c - z.c, 4) AS delta_min, m.a >= z.a AND m.b >= z.b AND m.c >= z.c AS no_regression, m.a > z.a OR m.b > z.b OR m.c > z.c AS improved FROM m, z WHERE m.arm <> 'BUILDING'""",
)
def declared_comparison(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("arm")).agg(F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.min("o_totalprice").alias("c"))
    z = m.where("arm = 'BUILDING'").select(*[F.col(k).alias(f"z{k}") for k in "abc"])  # one row
    out = m.where("arm <> 'BUILDING'").crossJoin(z)
    deltas = [(F.round(F.col(k) - F.col(f"z{k}"), 4) + 0.0).alias(n) for k, n in (("a", "delta_mean"), ("b", "delta_max"), ("c", "delta_min"))]
    return out.select("arm", *deltas, F.expr("a >= za AND b >= zb AND c >= zc").alias("no_regression"), F.expr("a > za OR b > zb OR c > zc").alias("improved"))


@query(
    "score_outcome",
    """WITH c AS (SELECT l_orderkey AS prediction, l_partkey AS item FROM lineitem), b AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), a AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01' AND l_returnflag = 'R' AND l_linestatus = 'O'),
j AS (SELECT prediction, count(*) AS cited, min(CASE WHEN b.item IS NULL THEN 0 ELSE 1 END) AS all_open, max(CASE WHEN a.item IS NULL THEN 1 ELSE 0 END) AS gone FROM c LEFT JOIN b ON b.item = c.item LEFT JOIN a ON a.item = c.item GROUP BY 1)
SELECT prediction, cited, CASE WHEN all_open = 0 THEN 'unscorable' WHEN gone = 1 THEN 'hit' ELSE 'miss' END AS outcome FROM j""",
)
def score_outcome(t):
    li = t.lineitem
    before = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("item"), F.lit(1).alias("open")).distinct()
    after = li.where((F.col("l_shipdate") >= F.lit("2000-06-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).select(F.col("l_partkey").alias("item"), F.lit(1).alias("still")).distinct()
    j = li.select(F.col("l_orderkey").alias("prediction"), F.col("l_partkey").alias("item")).join(before, "item", "left").join(after, "item", "left")
    out = j.groupBy("prediction").agg(F.count("*").alias("cited"), F.bool_and(F.col("open").isNotNull()).alias("all_open"), F.bool_or(F.col("still").isNull()).alias("gone"))
    return out.select("prediction", "cited", F.when(~F.col("all_open"), "unscorable").when(F.col("gone"), "hit").otherwise("miss").alias("outcome"))


@query(
    "poisson_deviance",
    """WITH d AS (SELECT user_id, event_type, count(*) AS y FROM events GROUP BY 1, 2), g AS (SELECT event_type, avg(y) AS mu FROM d GROUP BY 1)
SELECT event_type, count(*) AS n, round(2 * sum(CASE WHEN y = 0 THEN 0 ELSE y * ln(y / mu) END - (y - mu)), 4) AS deviance FROM d JOIN g USING (event_type) GROUP BY event_type""",
)
def poisson_deviance(t):
    d = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("y"))
    j = d.join(d.groupBy("event_type").agg(F.avg("y").alias("mu")), "event_type")
    y, mu = F.col("y"), F.col("mu")
    return rounded(j.groupBy("event_type").agg(F.count("*").alias("n"), (2 * F.sum(F.when(y == 0, 0.0).otherwise(y * F.log(y / mu)) - (y - mu))).alias("deviance")), "deviance", places=4)


@query(
    "conditional_rmse",
    """WITH q AS (SELECT quantile_cont(l_quantity, 0.75) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS rmse FROM lineitem, q WHERE l_quantity > a AND l_extendedprice > b GROUP BY 1""",
)
def conditional_rmse(t):
    q = O.quantiles(t.lineitem, "l_quantity", {"a": 0.75}).crossJoin(O.quantiles(t.lineitem, "l_extendedprice", {"b": 0.75}))  # one row each
    e = F.col("l_tax") - F.col("l_discount")
    return rounded(t.lineitem.crossJoin(q).where("l_quantity > a AND l_extendedprice > b").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), "rmse")


@query(
    "akaike_weights",
    """WITH g AS (SELECT event_type AS model, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1), o AS (SELECT avg(value) AS x FROM events),
l AS (SELECT model, -0.5 * (ln(2 * pi() * (v / n + pow(CAST(0.02 AS DOUBLE) * abs(m) + CAST(0.01 AS DOUBLE), 2))) + pow(x - m, 2) / (v / n + pow(CAST(0.02 AS DOUBLE) * abs(m) + CAST(0.01 AS DOUBLE), 2))) AS ll FROM g, o),
a AS (SELECT model, ll, 4 - 2 * ll AS aic FROM l), d AS (SELECT *, aic - min(aic) OVER () AS delta FROM a)
SELECT model, round(ll, 6) AS log_likelihood, round(aic, 6) AS aic, round(exp(-0.5 * delta) / sum(exp(-0.5 * delta)) OVER (), 6) AS weight FROM d""",
)
def akaike_weights(t):
    g = t.events.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    o = t.events.agg(F.avg("value").alias("x"))  # one row
    var = F.col("v") / F.col("n") + F.pow(0.02 * F.abs("m") + 0.01, F.lit(2))
    a = g.crossJoin(o).select("model", (-0.5 * (F.log(2 * F.pi() * var) + F.pow(F.col("x") - F.col("m"), F.lit(2)) / var)).alias("log_likelihood")).withColumn("aic", 4 - 2 * F.col("log_likelihood"))
    every = Window.partitionBy()  # one row per model
    w = F.exp(-0.5 * (F.col("aic") - F.min("aic").over(every)))
    return rounded(a.withColumn("w", w).withColumn("weight", F.col("w") / F.sum("w").over(every)).drop("w"), "log_likelihood", "aic", "weight")


@query("pooled_variance", "WITH g AS (SELECT event_type, user_id, count(*) AS n, var_samp(value) AS v FROM events GROUP BY 1, 2 HAVING count(*) > 1) SELECT event_type, count(*) AS groups, round(sum(v * (n - 1)) / sum(n - 1), 4) AS pooled, round(avg(v), 4) AS mean_variance FROM g GROUP BY 1")
def pooled_variance(t):
    g = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.var_samp("value").alias("v")).where("n > 1")
    return rounded(g.groupBy("event_type").agg(F.count("*").alias("groups"), (F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("pooled"), F.avg("v").alias("mean_variance")), "pooled", "mean_variance", places=4)
