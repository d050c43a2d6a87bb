"""Graphs, lineage and typed triples on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import r6
from ..storage import Store
from .base import query
from .scoring import rounded

#: Parts on neighbouring lines of an order are linked: as many edges as lines, and none left out.
_E = """e AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem) WHERE p <> q)"""
_B = "w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), g AS (SELECT a AS node, count(*) AS degree FROM w GROUP BY 1)"


def edges(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return G.simple_edges(t.lineitem.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b IS NOT NULL"))


@query("degree_strength", "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, sum(l_quantity) OVER (PARTITION BY l_suppkey, l_partkey) AS q FROM lineitem) SELECT s AS node, count(*) AS degree, round(sum(q), 4) AS strength, round(count(*) / CAST((SELECT count(DISTINCT l_partkey) FROM lineitem) AS DOUBLE), 6) AS density FROM x GROUP BY s")
def degree_strength(t):
    x = t.lineitem.groupBy(F.col("l_suppkey").alias("node"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    n = t.lineitem.agg(F.countDistinct("l_partkey").alias("n"))  # one row
    g = x.groupBy("node").agg(F.count("*").alias("degree"), F.round(F.sum("q"), 4).alias("strength"))
    return g.crossJoin(n).select("node", "degree", "strength", r6(F.col("degree") / F.col("n")).alias("density"))


@query("triangles", f"WITH {_E} SELECT x.a AS x, x.b AS y, y.b AS z FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def triangles(t):
    v = F.array_sort(F.array("x", "y", "z"))
    return G.triangles(edges(t)).select(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


@query(
    "clustering",
    f"""WITH {_E}, {_B}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), n AS (SELECT node, count(*) AS k FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1)
SELECT g.node, degree, coalesce(k, 0) AS triangles, CASE WHEN degree > 1 THEN round(2 * coalesce(k, 0) / CAST(degree * (degree - 1) AS DOUBLE), 6) ELSE CAST(0 AS DOUBLE) END AS clustering FROM g LEFT JOIN n ON n.node = g.node""",
)
def clustering(t):
    return rounded(G.clustering(edges(t)), "clustering")


@query("components")  # a recursive closure over all edges is dear in SQL: tested against brute force
def components(t):
    return G.components(edges(t), Store(t.spark, "components"))


_F = "f AS (SELECT l_suppkey % 12 AS src, l_partkey % 12 AS dst, CASE WHEN round(avg(l_discount), 12) > CAST(0.05 AS DOUBLE) THEN 1 ELSE -1 END AS w FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 GROUP BY 1, 2)"


@query(
    "feedback_loops",
    f"""WITH {_F}, l2 AS (SELECT a.src AS x, a.dst AS y, a.w * b.w AS gain FROM f a JOIN f b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst),
l3 AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, a.w * b.w * c.w AS gain FROM f a JOIN f b ON a.dst = b.src JOIN f c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT x || '-' || y AS loop, CAST(gain AS BIGINT) AS gain, CASE WHEN gain < 0 THEN 'balancing' ELSE 'reinforcing' END AS polarity FROM l2 UNION ALL SELECT x || '-' || y || '-' || z, CAST(gain AS BIGINT), CASE WHEN gain < 0 THEN 'balancing' ELSE 'reinforcing' END FROM l3""",
)
def feedback_loops(t):
    s, d = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    # averages are rounded, so that a tie at 0.05 does not hang on the order of the sum
    e = t.lineitem.where(s != d).groupBy(s.alias("src"), d.alias("dst")).agg(F.when(F.round(F.avg("l_discount"), 12) > 0.05, 1).otherwise(-1).cast("long").alias("weight"))
    return G.cycles(e, 3).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("loop"), "gain", "polarity")


@query("percolation", f"WITH {_E}, {_B} SELECT count(*) AS nodes, round(avg(degree), 6) AS mean_degree, round(avg(degree * degree), 4) AS second_moment, round(avg(degree) / (avg(degree * degree) - avg(degree)), 6) AS threshold, round(avg(degree * degree) / avg(degree), 6) AS molloy_reed FROM g")
def percolation(t):
    d = F.col("degree")
    g = G.degrees(edges(t)).agg(F.count("*").alias("nodes"), F.avg(d).alias("mean_degree"), F.avg(d * d).alias("second_moment"))
    m, s = F.col("mean_degree"), F.col("second_moment")
    return rounded(rounded(g.withColumns({"threshold": m / F.nullif(s - m, F.lit(0.0)), "molloy_reed": s / m}), "mean_degree", "threshold", "molloy_reed"), "second_moment", places=4)


@query("topk_degree", f"WITH {_E}, {_B} SELECT node, degree, CAST(row_number() OVER (ORDER BY degree DESC, node) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (ORDER BY degree DESC, node) <= 10")
def topk_degree(t):
    top = G.degrees(edges(t)).orderBy(F.desc("degree"), "node").limit(10)  # the limit is the feature
    return top.select("node", "degree", F.row_number().over(Window.orderBy(F.desc("degree"), "node")).alias("rank"))


#: Parent forest: region > nation > customer > order.
_P = """p AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def forest(t):
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    none = F.lit(None).cast("string").alias("parent")
    rows = [t.region.select(tag("r", "r_regionkey").alias("id"), none), t.nation.select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent")), t.customer.select(tag("c", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("parent")), t.orders.select(tag("o", "o_orderkey").alias("id"), tag("c", "o_custkey").alias("parent"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("stale_closure", f"WITH RECURSIVE {_P}, s(id) AS (SELECT id FROM p WHERE id IN ('n3', 'n7') UNION ALL SELECT p.id FROM p JOIN s ON p.parent = s.id) SELECT id FROM s")
def stale_closure(t):
    p = forest(t)
    return G.descend(p, p.where(F.col("id").isin("n3", "n7")).select("id"), t.spark).select("id")


@query("lineage_depth", f"WITH RECURSIVE {_P}, s(id, depth, root) AS (SELECT id, 0, id FROM p WHERE parent IS NULL UNION ALL SELECT p.id, s.depth + 1, s.root FROM p JOIN s ON p.parent = s.id) SELECT root, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM s GROUP BY 1, 2")
def lineage_depth(t):
    p = forest(t)
    return G.descend(p, p.where("parent IS NULL").select("id"), t.spark).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("lineage_export", f"WITH RECURSIVE {_P}, s(id, depth) AS (SELECT id, 0 FROM p WHERE id = 'r1' UNION ALL SELECT p.id, s.depth + 1 FROM p JOIN s ON p.parent = s.id WHERE s.depth < 8) SELECT s.id, p.parent, CAST(depth AS INTEGER) AS depth FROM s JOIN p ON p.id = s.id")
def lineage_export(t):
    p = forest(t)
    return G.descend(p, p.where("id = 'r1'").select("id"), t.spark, 8).join(p, "id").select("id", "parent", "depth")


@query("ancestors", f"WITH RECURSIVE {_P}, a(start, id) AS (SELECT id, parent FROM p WHERE id LIKE 'c%' UNION ALL SELECT a.start, p.parent FROM a JOIN p ON p.id = a.id WHERE p.parent IS NOT NULL) SELECT start, count(*) AS n_ancestors, max(id) AS top FROM a GROUP BY start")
def ancestors(t):
    p = forest(t)
    return G.ancestors(p, p.where("id LIKE 'c%'").select("id"), t.spark).groupBy("start").agg(F.count("*").alias("n_ancestors"), F.max("id").alias("top"))


_T = """t AS (SELECT 'c' || c_custkey AS subject, 'in' AS predicate, 'n' || c_nationkey AS object FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'label', r_name FROM region)"""


def triples(t):
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    many = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    c = many(t.customer, row(tag("c", "c_custkey"), "in", tag("n", "c_nationkey")), row(tag("c", "c_custkey"), "segment", F.col("c_mktsegment")))
    n = many(t.nation, row(tag("n", "n_nationkey"), "in", tag("r", "n_regionkey")), row(tag("n", "n_nationkey"), "label", F.col("n_name")))
    return c.unionByName(n).unionByName(many(t.region, row(tag("r", "r_regionkey"), "label", F.col("r_name"))))


@query("rdf_triples", f"WITH {_T} SELECT DISTINCT subject, predicate, object FROM t")
def rdf_triples(t):
    return triples(t).distinct()


@query(
    "ontology_findings",
    f"""WITH {_T}, s AS (SELECT DISTINCT subject FROM t) SELECT finding, count(*) AS n FROM (
 SELECT 'dangling_object' AS finding, object AS x FROM t WHERE predicate = 'in' AND object NOT IN (SELECT subject FROM s)
 UNION ALL SELECT 'no_label', subject FROM s WHERE subject NOT IN (SELECT subject FROM t WHERE predicate = 'label')
 UNION ALL SELECT 'leaf', subject FROM s WHERE subject NOT IN (SELECT object FROM t WHERE predicate = 'in')
 UNION ALL SELECT 'repeated_relation', subject FROM t GROUP BY subject, predicate HAVING count(*) > 1) GROUP BY finding""",
)
def ontology_findings(t):
    x = triples(t)
    s = x.select("subject").distinct()
    inside = x.where("predicate = 'in'").select(F.col("object").alias("subject"))
    named = x.where("predicate = 'label'").select("subject")
    found = [
        inside.join(s, "subject", "left_anti").select(F.lit("dangling_object").alias("finding")),
        s.join(named, "subject", "left_anti").select(F.lit("no_label").alias("finding")),
        s.join(inside, "subject", "left_anti").select(F.lit("leaf").alias("finding")),
        x.groupBy("subject", "predicate").count().where("count > 1").select(F.lit("repeated_relation").alias("finding")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("finding").agg(F.count("*").alias("n"))


@query(
    "cascade_stats",
    """WITH a AS (SELECT event_type AS cascade, user_id, min(epoch(ts)) AS seen FROM events GROUP BY 1, 2), s AS (SELECT *, seen - min(seen) OVER (PARTITION BY cascade) AS age, row_number() OVER (PARTITION BY cascade ORDER BY seen, user_id) AS k, count(*) OVER (PARTITION BY cascade) AS n FROM a)
SELECT cascade, count(*) AS size, round(max(age), 3) AS duration, round(min(CASE WHEN 2 * k >= n THEN age END), 3) AS half_time, round(avg(age), 3) AS mean_age, CAST(sum(CASE WHEN age <= 86400 THEN 1 ELSE 0 END) AS BIGINT) AS first_day FROM s GROUP BY cascade""",
)
def cascade_stats(t):
    from ..session import epoch

    a = t.events.groupBy(F.col("event_type").alias("cascade"), "user_id").agg(F.min(epoch("ts")).alias("at"))
    g = Window.partitionBy("cascade")
    s = a.withColumns({"age": F.col("at") - F.min("at").over(g), "k": F.row_number().over(g.orderBy("at", "user_id")), "n": F.count("*").over(g)})
    out = s.groupBy("cascade").agg(F.count("*").alias("size"), F.max("age").alias("duration"), F.min(F.when(2 * F.col("k") >= F.col("n"), F.col("age"))).alias("half_time"), F.avg("age").alias("mean_age"), F.count_if(F.col("age") <= 86400).alias("first_day"))
    return rounded(out, "duration", "half_time", "mean_age", places=3)


_N3 = "SELECT node FROM g ORDER BY degree DESC, node LIMIT 3"


def hubs(t):
    return G.degrees(edges(t)).orderBy(F.desc("degree"), "node").limit(3).select("node")


@query(
    "path_lengths",
    f"""WITH RECURSIVE {_E}, {_B}, s AS ({_N3}), r(source, node, d) AS (SELECT node, node, 0 FROM s UNION SELECT r.source, w.b, r.d + 1 FROM r JOIN w ON w.a = r.node WHERE r.d < 12), m AS (SELECT source, node, min(d) AS d FROM r GROUP BY 1, 2 HAVING min(d) > 0)
SELECT round(avg(d), 6) AS mean_path_length, CAST(max(d) AS INTEGER) AS diameter, round(count(*) / CAST(3 * ((SELECT count(*) FROM g) - 1) AS DOUBLE), 6) AS connected_fraction FROM m""",
)
def path_lengths(t):
    e = Store(t.spark, "paths").put(edges(t))
    n = G.degrees(e).count()
    return rounded(G.path_summary(G.path_lengths(e, hubs(t), t.spark), n, 3), "mean_path_length", "connected_fraction")


@query(
    "remove_hubs",
    f"WITH {_E}, {_B}, s AS ({_N3}), x AS (SELECT a, b FROM e WHERE a NOT IN (SELECT node FROM s) AND b NOT IN (SELECT node FROM s)) SELECT (SELECT count(*) FROM e) AS edges_before, count(*) AS edges_after, (SELECT count(*) FROM (SELECT a FROM x UNION SELECT b FROM x)) AS nodes_after FROM x",
)
def remove_hubs(t):
    e = edges(t)
    x = G.remove_nodes(e, hubs(t))
    nodes = G.degrees(x).agg(F.count("*").alias("nodes_after"))  # one row each
    return e.agg(F.count("*").alias("edges_before")).crossJoin(x.agg(F.count("*").alias("edges_after"))).crossJoin(nodes)


@query("remove_edges", f"WITH {_E}, x AS (SELECT a, b FROM e WHERE NOT (a < 50 AND b > 100)) SELECT a AS node, count(*) AS edges FROM x GROUP BY a")
def remove_some_edges(t):
    e = edges(t)
    gone = e.where("a < 50 AND b > 100").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return G.remove_edges(e, gone).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("edges"))


_C = """n AS (SELECT DISTINCT user_id AS node FROM events), l AS (SELECT node, node % 3 AS community FROM n), e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON b.node = a.node + 7)"""


@query(
    "cross_community",
    f"""WITH {_C}, p AS (SELECT node, community, node % 7 AS start, node - lag(node) OVER (PARTITION BY node % 7 ORDER BY node) = 7 AS linked FROM l), c AS (SELECT node, community, start || '-' || sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY start ORDER BY node) AS comp FROM p),
k AS (SELECT comp, community, CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY 1, 2), i AS (SELECT sum(x) AS x FROM (SELECT sum(k) * (sum(k) - 1) / 2 - sum(k * (k - 1) / 2) AS x FROM k GROUP BY comp)), t AS (SELECT sum(k) * (sum(k) - 1) / 2 - sum(k * (k - 1) / 2) AS x FROM (SELECT sum(k) AS k FROM k GROUP BY community))
SELECT i.x AS connected_cross_pairs, t.x AS total_cross_pairs, (SELECT count(*) FROM e WHERE a % 3 <> b % 3) AS cross_edges, round(i.x / t.x, 6) AS fraction FROM i, t""",
)
def cross_community(t):
    n = t.events.select(F.col("user_id").alias("node")).distinct()
    e = n.select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")).join(n.select(F.col("node").alias("b")), "b").select("a", "b")
    labels = n.withColumn("community", F.col("node") % 3)
    return rounded(G.cross_community(e, labels, G.components(e, Store(t.spark, "cross"))), "fraction")


@query(
    "loop_dominance",
    f"""WITH {_F}, v AS (SELECT src, dst, w * (src + dst + 1) AS w FROM f), l AS (SELECT a.src || '-' || a.dst AS loop, a.w * b.w AS gain, 2 AS length FROM v a JOIN v b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '-' || a.dst || '-' || b.dst, a.w * b.w * c.w, 3 FROM v a JOIN v b ON a.dst = b.src JOIN v c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT loop, CASE WHEN gain < 0 THEN 'balancing' ELSE 'reinforcing' END AS polarity, CAST(gain AS BIGINT) AS gain, CAST(row_number() OVER (ORDER BY abs(gain) DESC, length, loop) AS INTEGER) AS rank, round(abs(gain) / CAST((SELECT sum(abs(gain)) FROM l) AS DOUBLE), 8) AS gain_share FROM l QUALIFY row_number() OVER (ORDER BY abs(gain) DESC, length, loop) <= 10""",
)
def loop_dominance(t):
    s, d = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    sign = F.when(F.round(F.avg("l_discount"), 12) > 0.05, 1).otherwise(-1).cast("long")
    e = t.lineitem.where(s != d).groupBy(s.alias("src"), d.alias("dst")).agg(sign.alias("sign")).select("src", "dst", (F.col("sign") * (F.col("src") + F.col("dst") + 1)).alias("weight"))
    loops = G.cycles(e, 3).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("loop"), F.size("path").alias("length"), "gain", "polarity")
    return rounded(G.loop_dominance(loops), "gain_share", places=8)


_J = "j AS (SELECT DISTINCT c_nationkey AS src, (c_custkey * 7 + 3) % 25 AS dst FROM customer WHERE c_acctbal < -800)"


@query(
    "claim_cycles",
    f"WITH RECURSIVE {_J}, r(a, b) AS (SELECT src, dst FROM j UNION SELECT r.a, j.dst FROM r JOIN j ON j.src = r.b) SELECT DISTINCT a AS node FROM r WHERE a = b",
)
def claim_cycles(t):
    return G.on_cycles(t.customer.where("c_acctbal < -800").select(F.col("c_nationkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % 25).alias("dst")), t.spark)


@query(
    "topology_findings",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS id, n_nationkey = 0 AS is_entry, n_nationkey IN (20, 21) AS is_terminal FROM nation), e AS (SELECT n_nationkey AS src, n_nationkey + 3 AS dst, 0.5 AS probability, 2 AS trav FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey - 6, CASE WHEN n_nationkey = 9 THEN 0.9 ELSE 0.25 END, CASE WHEN n_nationkey = 12 THEN NULL ELSE 30 END FROM nation WHERE n_nationkey IN (9, 12, 16) UNION ALL SELECT 0, 6, 0.5, 1),
f(id) AS (SELECT id FROM n WHERE is_entry UNION SELECT e.dst FROM f JOIN e ON e.src = f.id), b(id) AS (SELECT id FROM n WHERE is_terminal UNION SELECT e.src FROM b JOIN e ON e.dst = b.id), c(a, z) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.z), u(a, z) AS (SELECT src, dst FROM e WHERE trav IS NULL UNION SELECT u.a, e.dst FROM u JOIN e ON e.src = u.z WHERE e.trav IS NULL),
k AS (SELECT DISTINCT a AS id FROM c WHERE a = z), comp AS (SELECT k.id, (SELECT min(c.z) FROM c WHERE c.a = k.id AND c.z IN (SELECT id FROM k) AND EXISTS (SELECT 1 FROM c d WHERE d.a = c.z AND d.z = k.id)) AS l FROM k),
bud AS (SELECT x.l, sum(e.trav * 2) AS budget, min(e.src) AS item FROM e JOIN comp x ON x.id = e.src JOIN comp y ON y.id = e.dst GROUP BY x.l), m AS (SELECT n.id, is_entry, is_terminal, sum(probability) AS mass FROM n LEFT JOIN e ON e.src = n.id GROUP BY 1, 2, 3)
SELECT 'unreachable' AS rule, CAST(id AS VARCHAR) AS item FROM n WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT 'cannot_end', CAST(id AS VARCHAR) FROM n WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT DISTINCT 'unbounded_cycle', CAST(a AS VARCHAR) FROM u WHERE a = z UNION ALL SELECT 'loop_budget', CAST(item AS VARCHAR) FROM bud WHERE budget > 64
UNION ALL SELECT 'no_way_out', CAST(id AS VARCHAR) FROM m WHERE NOT is_terminal AND mass IS NULL UNION ALL SELECT 'probability_mass', CAST(id AS VARCHAR) FROM m WHERE mass <= 0 OR mass > 1.000001 UNION ALL SELECT 'entry_mass', CAST(id AS VARCHAR) FROM m WHERE is_entry AND abs(coalesce(mass, 0) - 1) > 0.000001""",
)
def topology_findings(t):
    k = F.col("n_nationkey")
    n = t.nation.select(k.alias("id"), (k == 0).alias("is_entry"), k.isin(20, 21).alias("is_terminal"))
    row = lambda dst, p, m: [k.alias("src"), dst.cast("long").alias("dst"), p.cast("double").alias("probability"), m.cast("int").alias("max_traversals"), F.lit(2).alias("attempts")]
    e = t.nation.where("n_nationkey < 20").select(*row(k + 3, F.lit(0.5), F.lit(2)))
    e = e.unionByName(t.nation.where("n_nationkey IN (9, 12, 16)").select(*row(k - 6, F.when(k == 9, 0.9).otherwise(0.25), F.when(k != 12, 30))))
    e = e.unionByName(t.nation.where("n_nationkey = 0").select(*row(F.lit(6), F.lit(0.5), F.lit(1))))
    return G.validate_topology(n, e, t.spark)


@query("k_core")  # peeling and iterations: tested against brute force
def k_core(t):
    return G.degrees(G.k_core(edges(t), 12, Store(t.spark, "core")))


@query("eigenvector_centrality")
def eigenvector_centrality(t):
    return rounded(G.eigenvector(edges(t), Store(t.spark, "eigen"), rounds=12).withColumnRenamed("x", "centrality"), "centrality", places=8)


@query("communities")
def communities(t):
    return G.label_propagation(edges(t), t.spark)


@query("betweenness")
def betweenness(t):
    """Paths from the three nodes of highest degree."""
    return rounded(G.betweenness(edges(t), hubs(t)), "betweenness")
