"""Governance reports on the driver's tables: parts are tasks, return flags are arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..session import day
from .base import query
from .scoring import rounded

_REPLAY = """a AS (SELECT l_partkey AS task, avg(l_quantity) AS main, avg(l_tax) AS tax, avg(l_discount) AS disc, CAST(count(*) AS DOUBLE) AS actions, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS checks, CAST(count(DISTINCT l_shipdate) AS DOUBLE) AS scope, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS task, avg(l_quantity) AS main, avg(l_tax) AS tax, avg(l_discount) AS disc, CAST(count(*) AS DOUBLE) AS actions, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS checks, CAST(count(DISTINCT l_shipdate) AS DOUBLE) AS scope, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
r AS (SELECT a.task, p_brand AS family, CASE WHEN p_size > 40 THEN 'holdout' ELSE 'train' END AS stage, CASE WHEN p_retailprice > 1000 THEN 'hard' ELSE 'easy' END AS difficulty, a.actions <= 12 AND b.actions <= 12 AS within_caps, a.top < 50 AS blinded, b.top < 50 AS accounted,
 a.main AS pm, b.main AS cm, a.tax AS pt, b.tax AS ct, a.disc AS pd, b.disc AS cd, a.actions AS pa, b.actions AS ca, a.checks AS pc, b.checks AS cc, a.scope AS ps, b.scope AS cs, a.actions > 1 AS ptry, b.actions > 1 AS ctry FROM a JOIN b USING (task) JOIN part ON p_partkey = a.task),
g AS (SELECT task, family, stage, difficulty, within_caps AND blinded AND accounted AS usable, unnest(['quantity', 'tax', 'discount']) AS proxy, unnest(['primary', 'protected', 'diagnostic']) AS role, unnest([cm - pm, pt - ct, cd - pd]) AS gain FROM r),
rep AS (SELECT proxy, role, CAST(sum(CASE WHEN usable THEN 1 ELSE 0 END) AS BIGINT) AS n_usable, CAST(sum(CASE WHEN usable THEN 0 ELSE 1 END) AS BIGINT) AS n_excluded, avg(CASE WHEN usable THEN gain END) AS mean_gain, CAST(sum(CASE WHEN usable AND stage = 'holdout' THEN 1 ELSE 0 END) AS BIGINT) AS n_holdout, avg(CASE WHEN usable AND stage = 'holdout' THEN gain END) AS holdout_gain FROM g GROUP BY 1, 2)"""
PROXIES = {"quantity": ("primary", "maximize"), "tax": ("protected", "minimize"), "discount": ("diagnostic", "maximize")}


def replays(t):
    def arm(flag, p):
        per = t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("task"))
        return per.agg(
            F.avg("l_quantity").alias(f"{p}_quantity"), F.avg("l_tax").alias(f"{p}_tax"), F.avg("l_discount").alias(f"{p}_discount"), F.count("*").cast("double").alias(f"{p}_actions"),
            F.countDistinct("l_suppkey").cast("double").alias(f"{p}_checks"), F.countDistinct("l_shipdate").cast("double").alias(f"{p}_scope"), F.max("l_quantity").alias(f"{p}_top"),
        )

    j = arm("A", "parent").join(arm("R", "child"), "task").join(t.part, F.col("task") == F.col("p_partkey"))
    return j.select(
        "*", F.col("p_brand").alias("family"), F.when(F.col("p_size") > 40, "holdout").otherwise("train").alias("stage"), F.when(F.col("p_retailprice") > 1000, "hard").otherwise("easy").alias("difficulty"),
        F.expr("parent_actions <= 12 AND child_actions <= 12").alias("within_caps"), F.expr("parent_top < 50").alias("blinded"), F.expr("child_top < 50").alias("accounted"), F.expr("parent_actions > 1").alias("parent_attempted"), F.expr("child_actions > 1").alias("child_attempted"),
    )


@query("replay_report", f"WITH {_REPLAY} SELECT proxy, role, n_usable, n_excluded, round(mean_gain, 8) AS mean_gain, n_holdout, round(holdout_gain, 8) AS holdout_gain, coalesce(mean_gain, 0) > 1e-12 AS improved, coalesce(mean_gain, 0) < -1e-12 AS regressed FROM rep")
def replay_report(t):
    return rounded(G.replay_report(G.gains(replays(t), PROXIES)), "mean_gain", "holdout_gain", places=8)


@query("replay_by_family", f"WITH {_REPLAY} SELECT family, difficulty, CAST(sum(CASE WHEN usable THEN 1 ELSE 0 END) AS BIGINT) AS n_usable, round(avg(CASE WHEN usable THEN gain END), 6) AS mean_gain FROM g WHERE role = 'primary' GROUP BY 1, 2")
def replay_by_family(t):
    g = G.gains(replays(t), PROXIES).where("role = 'primary'")
    return rounded(G.replay_report(g, ["family", "difficulty"]).select("family", "difficulty", "n_usable", "mean_gain"), "mean_gain")


@query(
    "promotion_rule",
    f"""WITH {_REPLAY}, c AS (SELECT CASE WHEN max(n_excluded) = 0 AND max(n_usable) > 0 THEN 'met' ELSE 'unmet' END AS accounting_complete, CASE WHEN max(CASE WHEN role = 'primary' THEN mean_gain END) IS NULL THEN 'unestablished' WHEN max(CASE WHEN role = 'primary' THEN mean_gain END) > 1e-12 THEN 'met' ELSE 'unmet' END AS primary_strict_gain,
 CASE WHEN max(CASE WHEN role = 'protected' AND coalesce(mean_gain, 0) < -1e-12 THEN 1 ELSE 0 END) = 1 THEN 'unmet' ELSE 'met' END AS no_protected_regression,
 CASE WHEN max(n_holdout) = 0 THEN 'unestablished' WHEN max(CASE WHEN role = 'primary' THEN holdout_gain END) > 1e-12 AND max(CASE WHEN role = 'protected' AND holdout_gain < -1e-12 THEN 1 ELSE 0 END) = 0 THEN 'met' ELSE 'unmet' END AS holdout_stage_passed FROM rep)
SELECT *, CASE WHEN accounting_complete = 'unmet' THEN 'inconclusive' WHEN no_protected_regression = 'unmet' OR primary_strict_gain = 'unmet' THEN 'reject' WHEN 'unestablished' IN (primary_strict_gain, no_protected_regression, holdout_stage_passed) THEN 'inconclusive' WHEN holdout_stage_passed = 'unmet' THEN 'reject' ELSE 'promote' END AS verdict FROM c""",
)
def promotion_rule(t):
    return G.promotion_rule(G.replay_report(G.gains(replays(t), PROXIES)))


_Z = G.NormalDist().inv_cdf(1 - G.ALPHA / 2) + G.NormalDist().inv_cdf(G.POWER)


@query(
    "power_report",
    f"""WITH d AS (SELECT p_brand AS g, count(*) AS n, stddev_samp(p_retailprice) AS sd, CAST(60 AS DOUBLE) AS effect FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT g, n, round(CAST({_Z!r} AS DOUBLE) * sd / sqrt(n), 4) AS detectable, CAST(ceil(pow(CAST({_Z!r} AS DOUBLE) * sd / effect, 2)) AS BIGINT) AS required, CAST(greatest(0, ceil(pow(CAST({_Z!r} AS DOUBLE) * sd / effect, 2)) - n) AS BIGINT) AS shortfall, CAST({_Z!r} AS DOUBLE) * sd / sqrt(n) > effect + 1e-12 AS underpowered FROM d""",
)
def power_report(t):
    d = t.part.groupBy(F.col("p_brand").alias("g")).agg(F.count("*").alias("n"), F.stddev_samp("p_retailprice").alias("sd"), F.lit(60.0).alias("effect")).where("n > 1")
    return rounded(G.power_report(d, "n", "sd", "effect").drop("sd", "effect"), "detectable", places=4)


@query(
    "divergence_report",
    f"""WITH {_REPLAY}, p AS (SELECT coalesce(max(mean_gain), 0) AS x FROM rep WHERE role = 'primary')
SELECT proxy, role, round(mean_gain, 8) AS mean_gain, x > 1e-12 AS primary_improved, ['low', 'medium', 'high', 'critical'][1 + least(3, CASE role WHEN 'protected' THEN 2 WHEN 'diagnostic' THEN 0 ELSE 1 END + CASE WHEN -mean_gain >= 0.0002 THEN 1 ELSE 0 END + CASE WHEN -mean_gain >= 0.0004 THEN 1 ELSE 0 END)] AS severity FROM rep, p WHERE role <> 'primary' AND mean_gain < -1e-12""",
)
def divergence_report(t):
    return rounded(G.divergence(G.replay_report(G.gains(replays(t), PROXIES)), 0.0002), "mean_gain", places=8)


@query(
    "gaming_checks",
    f"""WITH {_REPLAY}, m AS (SELECT avg(CASE WHEN within_caps AND blinded AND accounted THEN pa END) AS pa, avg(CASE WHEN within_caps AND blinded AND accounted THEN ca END) AS ca, avg(CASE WHEN within_caps AND blinded AND accounted THEN pc END) AS pc, avg(CASE WHEN within_caps AND blinded AND accounted THEN cc END) AS cc,
 avg(CASE WHEN within_caps AND blinded AND accounted THEN ps END) AS ps, avg(CASE WHEN within_caps AND blinded AND accounted THEN cs END) AS cs, CAST(sum(CASE WHEN ptry THEN 1 ELSE 0 END) AS DOUBLE) AS pall, CAST(sum(CASE WHEN ctry THEN 1 ELSE 0 END) AS DOUBLE) AS call, sum(CASE WHEN ptry AND difficulty = 'hard' THEN 1 ELSE 0 END) AS phard, sum(CASE WHEN ctry AND difficulty = 'hard' THEN 1 ELSE 0 END) AS chard FROM r)
SELECT "check", round(parent, 6) AS parent, round(child, 6) AS child, round(ratio, 6) AS ratio, triggered FROM (SELECT 'shortened_investigations' AS "check", pa AS parent, ca AS child, ca / pa AS ratio, ca / pa < 0.75 AS triggered FROM m UNION ALL SELECT 'skipped_checks', pc, cc, cc / pc, cc / pc < 0.9 FROM m UNION ALL SELECT 'narrowed_scope', ps, cs, cs / ps, cs / ps < 0.75 FROM m UNION ALL SELECT 'avoided_hard_tasks', pall, call, NULL, chard < phard OR call < pall FROM m)""",
)
def gaming_checks(t):
    return rounded(G.gaming_checks(replays(t)), "parent", "child", "ratio")


_GEN = "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS arm, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS generation, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS improvements, sum(value) AS cost, count(DISTINCT user_id) > 1 AS fresh FROM events GROUP BY 1, 2"


@query(
    "meta_policies",
    f"""WITH g AS ({_GEN}), p AS (SELECT arm, count(*) AS n, sum(improvements) AS wins, sum(cost) AS cost, bool_and(fresh) AS fresh FROM g GROUP BY arm), x AS (SELECT a.wins / a.cost AS pa, b.wins / b.cost AS pb, a.n >= 3 AND b.n >= 3 AS enough, abs(a.cost - b.cost) <= 0.05 * greatest(a.cost, b.cost) AS equal_budget, a.fresh AND b.fresh AS fresh FROM p a, p b WHERE a.arm = 'click' AND b.arm = 'view')
SELECT round(pa, 9) AS productivity_a, round(pb, 9) AS productivity_b, enough, equal_budget, fresh, CASE WHEN NOT (enough AND equal_budget AND fresh) THEN 'inconclusive' WHEN abs(pa - pb) <= 1e-12 THEN 'no_difference_established' WHEN pa > pb THEN 'a_more_productive' ELSE 'b_more_productive' END AS verdict FROM x""",
)
def meta_policies(t):
    arm = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    g = t.events.groupBy(arm.alias("arm"), day("ts").alias("generation")).agg(F.count_if(F.col("value") > 100).alias("improvements"), F.sum("value").alias("cost"), (F.countDistinct("user_id") > 1).alias("fresh"))
    return rounded(G.compare_meta_policies(g, "click", "view"), "productivity_a", "productivity_b", places=9)


@query("usage_deltas", "WITH d AS (SELECT user_id AS k, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, max(event_id) AS total FROM events GROUP BY 1, 2), l AS (SELECT *, lag(total) OVER (PARTITION BY k ORDER BY day) AS b FROM d) SELECT k, day, total, CASE WHEN b IS NULL OR total < b THEN total ELSE total - b END AS used, total < b AS restarted FROM l")
def usage_deltas(t):
    d = t.events.groupBy(F.col("user_id").alias("k"), day("ts").alias("day")).agg(F.max("event_id").alias("total"))
    return G.usage_deltas(d, "k", "day", "total")


@query(
    "stagnation",
    """WITH e AS (SELECT event_type || '-' || user_id % 7 AS operator, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS generation, value > 180 AS accepted FROM events), c AS (SELECT max(generation) AS g FROM e)
SELECT operator, count(*) AS attempts, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN generation > g - 5 THEN 1 ELSE 0 END) AS BIGINT) AS recent_attempts, CAST(sum(CASE WHEN generation > g - 5 AND accepted THEN 1 ELSE 0 END) AS BIGINT) AS recent_accepted, max(CASE WHEN accepted THEN generation END) AS last_accepted, count(*) >= 3 AND sum(CASE WHEN generation > g - 5 AND accepted THEN 1 ELSE 0 END) = 0 AS exhausted FROM e, c GROUP BY operator""",
)
def stagnation(t):
    e = t.events.select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("operator"), day("ts").alias("generation"), (F.col("value") > 180).alias("accepted"))
    return G.stagnation(e.crossJoin(e.agg(F.max("generation").alias("g"))), F.col("g"))  # one row


@query(
    "branch_productivity",
    """WITH n AS (SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS generation, o_totalprice > 200000 AS accepted, o_custkey FROM orders), c AS (SELECT max(generation) AS g FROM n)
SELECT CASE WHEN c_nationkey IS NULL THEN 'unrooted' ELSE CAST(c_nationkey AS VARCHAR) END AS seed, count(*) AS candidates, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted, max(g) - max(CASE WHEN accepted THEN generation END) AS since_accepted FROM n LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0, c GROUP BY 1""",
)
def branch_productivity(t):
    n = t.orders.select(F.col("o_orderkey").alias("id"), (day("o_orderdate") - 8035).alias("generation"), (F.col("o_totalprice") > 200000).alias("accepted"))
    n = n.crossJoin(n.agg(F.max("generation").alias("g")))  # one row
    a = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("string").alias("seed"))
    return G.branches(n, a, F.col("g"))


@query(
    "generation_deltas",
    """WITH b AS (SELECT p_brand || p_type AS cell, p_size AS generation, max(p_retailprice) AS s FROM part GROUP BY 1, 2), o AS (SELECT *, max(s) OVER (PARTITION BY cell ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM b),
e AS (SELECT generation, count(CASE WHEN old IS NULL THEN 1 END) AS n, coalesce(sum(CASE WHEN old IS NULL OR s > old THEN s - coalesce(old, 0) END), 0) AS q FROM o GROUP BY 1)
SELECT generation, round(n / CAST(500 AS DOUBLE), 6) AS coverage_delta, round(q, 4) AS qd_delta, round(sum(n) OVER w / CAST(500 AS DOUBLE), 6) AS coverage, round(sum(q) OVER w, 3) AS qd_score, n > 0 OR q > 1e-12 AS improved FROM e WINDOW w AS (ORDER BY generation)""",
)
def generation_deltas(t):
    c = t.part.select(F.concat("p_brand", "p_type").alias("cell"), F.col("p_size").alias("generation"), F.col("p_retailprice").alias("score"))
    out = rounded(G.generation_deltas(c, 500), "coverage_delta", "coverage")
    return rounded(rounded(out, "qd_delta", places=4), "qd_score", places=3)
