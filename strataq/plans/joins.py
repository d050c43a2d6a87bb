"""Join operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import day, epoch, r6
from .base import query

_RISK = """
WITH l AS (SELECT CAST({lk} AS VARCHAR) AS k, count(*) AS lc FROM {left} GROUP BY 1), r AS (SELECT CAST({rk} AS VARCHAR) AS k, count(*) AS rc FROM {right} GROUP BY 1),
lb AS (SELECT CAST(coalesce(sum(CASE WHEN k IS NULL OR trim(k) = '' THEN lc END), 0) AS BIGINT) AS n FROM l), rb AS (SELECT CAST(coalesce(sum(CASE WHEN k IS NULL OR trim(k) = '' THEN rc END), 0) AS BIGINT) AS n FROM r),
j AS (SELECT k, lc, rc FROM (SELECT * FROM l WHERE k IS NOT NULL AND trim(k) <> '') FULL JOIN (SELECT * FROM r WHERE k IS NOT NULL AND trim(k) <> '') USING (k)),
s AS (SELECT count(lc) AS left_keys, count(rc) AS right_keys, CAST(sum(CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched_keys,
  CAST(coalesce(sum(lc * rc), 0) AS BIGINT) AS output_rows, coalesce(max(lc), 0) AS left_fanout, coalesce(max(rc), 0) AS right_fanout,
  CAST(coalesce(sum(CASE WHEN rc IS NULL THEN lc END), 0) AS BIGINT) AS left_unmatched_rows, CAST(coalesce(sum(CASE WHEN lc IS NULL THEN rc END), 0) AS BIGINT) AS right_unmatched_rows,
  CAST(coalesce(sum(lc), 0) + (SELECT n FROM lb) AS BIGINT) AS left_rows, CAST(coalesce(sum(rc), 0) + (SELECT n FROM rb) AS BIGINT) AS right_rows,
  (SELECT n FROM lb) AS left_blank, (SELECT n FROM rb) AS right_blank FROM j),
f AS (SELECT *, left_fanout * right_fanout AS max_fanout_product, round(left_unmatched_rows / CAST(left_rows AS DOUBLE), 6) AS left_unmatched_fraction,
  round(right_unmatched_rows / CAST(right_rows AS DOUBLE), 6) AS right_unmatched_fraction, round(output_rows / CAST(left_rows AS DOUBLE), 6) AS blowup,
  CASE WHEN left_fanout = 1 AND right_fanout = 1 THEN 'one_to_one' WHEN left_fanout = 1 THEN 'one_to_many' WHEN right_fanout = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality FROM s),
g AS (SELECT *, concat_ws(',', CASE WHEN matched_keys = 0 THEN 'no_matching_keys' END, CASE WHEN cardinality = 'many_to_many' THEN 'many_to_many_cardinality' END, CASE WHEN blowup > 2 THEN 'row_blowup_above_2x' END,
  CASE WHEN greatest(left_unmatched_fraction, right_unmatched_fraction) > 0.5 THEN 'majority_unmatched' END, CASE WHEN left_blank + right_blank > 0 THEN 'null_or_missing_keys' END,
  CASE WHEN greatest(left_unmatched_fraction, right_unmatched_fraction) > 0.1 AND greatest(left_unmatched_fraction, right_unmatched_fraction) <= 0.5 THEN 'unmatched_above_10_percent' END) AS reasons FROM f)
SELECT *, CAST(0 AS BIGINT) AS near_misses, CASE WHEN matched_keys = 0 THEN 'blocked' WHEN cardinality = 'many_to_many' OR blowup > 2 OR greatest(left_unmatched_fraction, right_unmatched_fraction) > 0.5 THEN 'high' WHEN reasons <> '' THEN 'elevated' ELSE 'low' END AS risk FROM g"""


@query("join_risk", _RISK.format(left="orders", right="lineitem", lk="o_orderkey", rk="l_orderkey"))
def join_risk(t):
    return J.join_risk(t.orders, t.lineitem, "o_orderkey", "l_orderkey").drop("near_shown")


@query("join_risk_labels", _RISK.format(left="documents", right="labels", lk="doc_id", rk="doc_id"))
def join_risk_labels(t):
    return J.join_risk(t.documents, t.labels, "doc_id", "doc_id").drop("near_shown")


_STOP = ", ".join(f"'{w}'" for w in J.STOP)
_NORM = "substr(trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')), 1, 200)"


@query(
    "entity_align",
    f"""
WITH lft AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name),
rgt AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_type AS name FROM part GROUP BY p_name, p_type
  UNION ALL SELECT 1000000 + min(p_partkey), upper(replace(p_name, ' ', '-')) || '!' FROM part WHERE p_size % 2 = 0 GROUP BY p_name HAVING min(p_partkey) % 2 = 0),
ln AS (SELECT id, {_NORM} AS n FROM lft), rn AS (SELECT id, {_NORM} AS n FROM rgt),
lt AS (SELECT id, n, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS w FROM ln),
rt AS (SELECT id, n, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS w FROM rn),
s AS (SELECT l.id AS l_id, r.id AS r_id, round(CAST(0.5 AS DOUBLE) * len(list_intersect(l.w, r.w)) / len(list_distinct(list_concat(l.w, r.w))) + CAST(0.5 AS DOUBLE) * (1 - levenshtein(l.n, r.n) / CAST(greatest(length(l.n), length(r.n), 1) AS DOUBLE)), 6) AS score FROM lt l, rt r),
c AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS k, lead(score) OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS nxt, count(*) OVER (PARTITION BY l_id) AS n FROM s WHERE score >= 0.6),
b AS (SELECT *, score >= 0.9 AND NOT coalesce(score - nxt <= CAST(0.02 AS DOUBLE), false) AS strong FROM c WHERE k = 1),
q AS (SELECT r_id, count(*) AS claims FROM b WHERE strong GROUP BY r_id)
SELECT lft.id AS left_id, CASE WHEN b.score IS NULL THEN 'unmatched' WHEN b.strong AND q.claims = 1 THEN 'matched' ELSE 'ambiguous' END AS status, b.r_id AS best_id, b.score, coalesce(b.n, 0) AS n_candidates
FROM lft LEFT JOIN b ON b.l_id = lft.id LEFT JOIN q ON q.r_id = b.r_id""",
)
def entity_align(t):
    p = t.part
    left = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    right = p.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    even = p.where("p_size % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("id")).where("id % 2 = 0")
    shout = even.select(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("!")).alias("name"), (F.col("id") + 1000000).alias("id"))
    return J.align_entities(left, right.unionByName(shout))


@query(
    "align_time",
    """
WITH e AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id FROM events),
s AS (SELECT series, t, t - lag(t) OVER (PARTITION BY series ORDER BY t, event_id) AS step FROM e),
m AS (SELECT series, step, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, min(t)) AS k FROM s WHERE step > 0 GROUP BY series, step),
p AS (SELECT series, count(*) AS n, min(t) AS start_at, max(t) AS end_at, max(t) - min(t) AS span, count(DISTINCT CASE WHEN step > 0 THEN step END) AS n_steps,
  CAST(sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_times FROM s GROUP BY series),
w AS (SELECT max(start_at) AS a, min(end_at) AS b FROM p)
SELECT p.*, m.step AS modal_step, n_steps = 1 AS regular, round(greatest(0, w.b - w.a) / CAST(p.span AS DOUBLE), 6) AS coverage,
  CASE WHEN w.b < w.a THEN 'blocked' WHEN n_steps = 1 THEN 'aligned_as_declared' ELSE 'resample_required' END AS verdict
FROM p JOIN m ON m.series = p.series AND m.k = 1 CROSS JOIN w""",
)
def align_time(t):
    e = t.events.select(F.col("event_type").alias("series"), F.floor(epoch("ts")).alias("t"), "event_id")
    out = J.align_time(e, "series", "t", ["event_id"])
    return out.withColumn("coverage", r6(F.col("coverage")))


@query("clock_shift", "SELECT unnest(['constant_offset', 'suspected_clock_shift', 'declared_timezone_mismatch', 'low_coverage']) AS finding, CAST(19800 AS DOUBLE) AS seconds FROM (SELECT 1) WHERE (SELECT count(*) FROM orders) > 0")
def clock_shift(t):
    """The first hours of order days, once in UTC and once labelled five and a half hours ahead."""
    h = t.orders.select((F.unix_date(F.col("o_orderdate").cast("date")) * 3600).alias("t")).distinct().orderBy("t").limit(100)
    return J.clock_findings(h.withColumn("zone", F.lit(0)), h.select((F.col("t") + 19800).alias("t"), F.lit(19800).alias("zone")))


@query(
    "adjacent_relations",
    """SELECT l_orderkey, low, high, v_high <= v_low AS coherent FROM (
  SELECT l_orderkey, l_linenumber AS low, l_discount AS v_low, lead(l_linenumber) OVER w AS high, lead(l_discount) OVER w AS v_high FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE high > low""",
)
def adjacent_relations(t):
    return J.adjacent(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice"], "l_discount")


@query(
    "near_match_reject",
    """SELECT user_id, count(*) AS n_rows, CAST(sum(CASE WHEN event_type <> f THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM (
  SELECT user_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) GROUP BY user_id""",
)
def near_match_reject(t):
    e = t.events
    first = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("f"))
    return e.join(first, "user_id").groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("event_type") != F.col("f")).alias("rejected"))


@query(
    "paired_effects",
    """WITH p AS (SELECT c_nationkey AS g, avg(c_acctbal) AS a FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS g, avg(s_acctbal) AS b FROM supplier GROUP BY 1)
SELECT count(*) AS n_groups, CAST(sum(CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpaired, round(avg(b - a), 6) AS mean_effect, round(min(b - a), 6) AS worst, round(max(b - a), 6) AS best,
 CAST(sum(CASE WHEN b < a THEN 1 ELSE 0 END) AS BIGINT) AS improved FROM p FULL JOIN c USING (g)""",
)
def paired_effects(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("g")).agg(F.avg("c_acctbal").alias("a"))
    c = t.supplier.groupBy(F.col("s_nationkey").alias("g")).agg(F.avg("s_acctbal").alias("b"))
    d = F.col("b") - F.col("a")
    return p.join(c, "g", "full").agg(F.count("*").alias("n_groups"), F.count_if(F.expr("a IS NULL OR b IS NULL")).alias("unpaired"), r6(F.avg(d)).alias("mean_effect"), r6(F.min(d)).alias("worst"), r6(F.max(d)).alias("best"), F.count_if(d < 0).alias("improved"))


@query(
    "left_join_latest",
    """SELECT c_custkey, CASE WHEN o_orderstatus IS NULL THEN 'none' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'scored' END AS status, o_orderkey AS latest
FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) o ON o_custkey = c_custkey AND k = 1""",
)
def left_join_latest(t):
    latest = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("o"))
    status = F.when(F.col("o").isNull(), "none").when(F.col("o.o_orderstatus") == "P", "pending").otherwise("scored")
    return t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", status.alias("status"), F.col("o.o_orderkey").alias("latest"))


@query(
    "paired_vs_baseline",
    """WITH m AS (SELECT o_orderpriority AS arm, date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS rep, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.arm, count(*) AS n_pairs, round(avg(a.v - b.v), 4) AS mean_difference, round(avg(CASE WHEN a.v > b.v THEN 1.0 ELSE 0.0 END), 6) AS fraction_better
FROM m a JOIN m b ON a.rep = b.rep AND b.arm = '1-URGENT' WHERE a.arm <> '1-URGENT' GROUP BY a.arm""",
)
def paired_vs_baseline(t):
    d = F.col("o_orderdate").cast("date")
    m = t.orders.groupBy(F.col("o_orderpriority").alias("arm"), ((F.year(d) - 1995) * 12 + F.month(d) - 1).alias("rep")).agg(F.avg("o_totalprice").alias("v"))
    base = m.where("arm = '1-URGENT'").select("rep", F.col("v").alias("b"))
    diff = F.col("v") - F.col("b")
    return m.where("arm <> '1-URGENT'").join(base, "rep").groupBy("arm").agg(F.count("*").alias("n_pairs"), (F.round(F.avg(diff), 4) + 0.0).alias("mean_difference"), r6(F.avg(F.when(diff > 0, 1.0).otherwise(0.0))).alias("fraction_better"))


@query(
    "edge_concordance",
    """WITH a AS (SELECT user_id AS u, min(epoch(ts)) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1),
e AS (SELECT DISTINCT user_id AS src, user_id + 1 AS dst FROM events)
SELECT count(*) AS n_edges, count(x.at) AS src_active, CAST(sum(CASE WHEN x.at IS NOT NULL AND y.at IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_active,
 CAST(sum(CASE WHEN y.at > x.at THEN 1 ELSE 0 END) AS BIGINT) AS forward, CAST(sum(CASE WHEN y.at > x.at AND y.at - x.at <= 172800 THEN 1 ELSE 0 END) AS BIGINT) AS concordant
FROM e LEFT JOIN a x ON x.u = e.src LEFT JOIN a y ON y.u = e.dst""",
)
def edge_concordance(t):
    a = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min(epoch("ts")).alias("at"))
    e = t.events.select(F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst")).distinct()
    j = e.join(a.select(F.col("user_id").alias("src"), F.col("at").alias("x")), "src", "left").join(a.select(F.col("user_id").alias("dst"), F.col("at").alias("y")), "dst", "left")
    return j.agg(F.count("*").alias("n_edges"), F.count("x").alias("src_active"), F.count_if(F.expr("x IS NOT NULL AND y IS NOT NULL")).alias("both_active"), F.count_if(F.expr("y > x")).alias("forward"), F.count_if(F.expr("y > x AND y - x <= 172800")).alias("concordant"))


_DAILY = "SELECT event_type AS series, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, count(*) AS v FROM events GROUP BY 1, 2"


def daily(t):
    return t.events.groupBy(F.col("event_type").alias("series"), day("ts").alias("t")).agg(F.count("*").cast("double").alias("v"))


@query(
    "offset_join",
    f"WITH d AS ({_DAILY}) SELECT b.t AS t, a.v AS clicks_before, b.v AS purchases FROM d a JOIN d b ON b.t = a.t + 1 WHERE a.series = 'click' AND b.series = 'purchase'",
)
def offset_join(t):
    d = daily(t).withColumn("v", F.col("v").cast("long"))
    a = d.where("series = 'click'").select((F.col("t") + 1).alias("t"), F.col("v").alias("clicks_before"))
    return d.where("series = 'purchase'").select("t", F.col("v").alias("purchases")).join(a, "t")


@query(
    "best_lag",
    f"""WITH d AS ({_DAILY}), p AS (SELECT b.series, b.t - a.t AS lag, CAST(a.v AS DOUBLE) AS x, CAST(b.v AS DOUBLE) AS y FROM d a JOIN d b ON b.t - a.t BETWEEN -5 AND 5 WHERE a.series = 'click' AND b.series <> 'click'),
m AS (SELECT series, lag, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) AS sx, sqrt(greatest(0, avg(y * y) - avg(y) * avg(y))) AS sy, avg(x * y) AS mxy FROM p GROUP BY 1, 2),
r AS (SELECT series, lag, n, round((mxy - mx * my) / (sx * sy), 6) AS r FROM m WHERE n >= 12 AND sx > 1e-6 AND sy > 1e-6)
SELECT series, lag, n, r FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r DESC, lag) AS k FROM r) WHERE k = 1""",
)
def best_lag(t):
    return J.best_lag(daily(t), "click")


_ASOF = """
SELECT {key}, id, round(coalesce(pv + (qv - pv) / nullif(qt - pt, 0) * (t - pt), pv, qv), 4) AS y FROM (
 SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt, last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qt, first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv
 FROM ({rows}) WINDOW w AS (PARTITION BY {key} ORDER BY t, v IS NULL, v, id)) WHERE id IS NOT NULL"""


@query(
    "asof_interpolate",
    _ASOF.replace("(w ROWS", "(PARTITION BY {key} ORDER BY t, v IS NULL, v, id ROWS").replace(" WINDOW w AS (PARTITION BY {key} ORDER BY t, v IS NULL, v, id)", "").format(
        key="user_id",
        rows="SELECT user_id, epoch(ts) AS t, value AS v, CAST(NULL AS BIGINT) AS id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, epoch(ts), NULL, event_id FROM events WHERE event_type = 'error'",
    ),
)
def asof_interpolate(t):
    series = t.events.where("event_type = 'view'").select("user_id", epoch("ts").alias("t"), F.col("value").alias("v"))
    at = t.events.where("event_type = 'error'").select("user_id", epoch("ts").alias("t"), F.col("event_id").alias("id"))
    return J.interpolate(series, at, ["user_id"]).select("user_id", "id", (F.round("y", 4) + 0.0).alias("y"))


@query(
    "resample_linear",
    _ASOF.replace("(w ROWS", "(PARTITION BY {key} ORDER BY t, v IS NULL, v, id ROWS").replace(" WINDOW w AS (PARTITION BY {key} ORDER BY t, v IS NULL, v, id)", "").format(
        key="event_type",
        rows="""SELECT event_type, epoch(ts) AS t, value AS v, CAST(NULL AS BIGINT) AS id FROM events
 UNION ALL SELECT event_type, CAST(d * 86400 AS DOUBLE), NULL, d FROM (SELECT event_type, unnest(range(a, b + 1)) AS d FROM (SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(min(ts) AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(max(ts) AS DATE)) AS b FROM events GROUP BY 1))""",
    ),
)
def resample_linear(t):
    series = t.events.select("event_type", epoch("ts").alias("t"), F.col("value").alias("v"))
    ends = t.events.groupBy("event_type").agg(day(F.min("ts")).alias("a"), day(F.max("ts")).alias("b"))
    grid = ends.select("event_type", F.explode(F.sequence("a", "b")).alias("id")).withColumn("t", (F.col("id") * 86400).cast("double"))
    return J.interpolate(series, grid, ["event_type"], bucket=3600.0).select("event_type", "id", (F.round("y", 4) + 0.0).alias("y"))


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]


@query("fk_orphans", "\nUNION ALL ".join(f"SELECT '{a}.{x}>{b}.{y}' AS relation, count(*) AS n_orphans, count(DISTINCT {x}) AS n_keys FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} z WHERE z.{y} = {a}.{x})" for a, x, b, y in _FKS))
def fk_orphans(t):
    parts = []
    for a, x, b, y in _FKS:
        gone = getattr(t, a).select(F.col(x).alias("k")).join(getattr(t, b).select(F.col(y).alias("k")), "k", "left_anti")
        parts.append(gone.agg(F.lit(f"{a}.{x}>{b}.{y}").alias("relation"), F.count("*").alias("n_orphans"), F.countDistinct("k").alias("n_keys")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "pareto_frontier",
    """SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size))""",
)
def pareto_frontier(t):
    return J.pareto(t.part, ["p_partkey"], "p_retailprice", "p_size")


@query(
    "snapshot_diff",
    """WITH b AS (SELECT o_custkey, o_orderpriority, count(*) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-01' GROUP BY 1, 2), a AS (SELECT o_custkey, o_orderpriority, count(*) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-01' GROUP BY 1, 2)
SELECT o_orderpriority, CAST(sum(CASE WHEN a.m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN b.m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "new",
 CAST(sum(CASE WHEN a.m IS NOT NULL AND b.m IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(coalesce(sum(b.m), 0) AS BIGINT) AS mass_before, CAST(coalesce(sum(a.m), 0) AS BIGINT) AS mass_after
FROM b FULL JOIN a USING (o_custkey, o_orderpriority) GROUP BY o_orderpriority""",
)
def snapshot_diff(t):
    cut = F.lit("1998-04-01").cast("timestamp_ntz")
    side = lambda c: t.orders.where(c).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("m"))
    return J.snapshot_diff(side(F.col("o_orderdate") < cut), side(F.col("o_orderdate") >= cut), ["o_custkey", "o_orderpriority"], "o_orderpriority", "m")


@query(
    "knn_embeddings",
    """SELECT query_id, vec_id, CAST(k AS INTEGER) AS rank, round(d, 4) AS distance FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS k
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE k <= 5""",
)
def knn_embeddings(t):
    return J.knn(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 5).withColumn("distance", F.round("distance", 4))


@query(
    "paired_replay",
    """WITH a AS (SELECT l_partkey AS task, sum(l_quantity) AS g, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS task, sum(l_quantity) AS g, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT task, b.g / b.n - a.g / a.n AS gain, CASE WHEN a.n IS NULL THEN 'no_parent' WHEN b.n IS NULL THEN 'no_child' WHEN a.n < 3 OR b.n < 3 THEN 'few_runs' ELSE 'paired' END AS state FROM a FULL JOIN b USING (task))
SELECT state, count(*) AS n_tasks, round(avg(gain), 6) AS mean_gain FROM j GROUP BY state""",
)
def paired_replay(t):
    side = lambda flag, g, n: t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("task")).agg(F.sum("l_quantity").alias(g), F.count("*").alias(n))
    j = side("A", "ga", "na").join(side("R", "gb", "nb"), "task", "full")
    state = F.when(F.col("na").isNull(), "no_parent").when(F.col("nb").isNull(), "no_child").when((F.col("na") < 3) | (F.col("nb") < 3), "few_runs").otherwise("paired")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n_tasks"), r6(F.avg(F.col("gb") / F.col("nb") - F.col("ga") / F.col("na"))).alias("mean_gain"))
