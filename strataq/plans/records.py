"""Records, views, diffs, exports and value rules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import records as R
from ..operators.profile import numeric_columns
from ..session import day, epoch, r6
from ..sources.readers import catalog, csv_context
from .base import query
from .graphs import _P, forest

LIB = "urn:x:"


@query("visible_records", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def visible_records(t):
    return R.visible(t.events, "event_type", ("error", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("observable_view", "SELECT event_id, user_id, event_type FROM events")
def observable_view(t):
    return R.view(t.events, ["event_id", "user_id", "event_type"])


@query("case_view", "SELECT * EXCLUDE (quality, toxic) FROM labels")
def case_view(t):
    return R.without(t.labels, ["quality", "toxic"])


@query(
    "scene_load",
    "SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS time, CAST(event_id AS VARCHAR) AS id, round(value, 6) AS x, CAST(user_id AS DOUBLE) AS y FROM events",
)
def scene_load(t):
    """Scenes of one agent and frame are written as JSON and loaded again."""
    agent = F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    scene = F.to_json(F.struct(F.array(F.struct(day("ts").cast("double").alias("time"), F.array(agent).alias("agents"))).alias("frames")))
    return R.load_scene(t.events.select("event_type", scene.alias("scene")), "event_type", "scene").withColumn("x", r6(F.col("x")))


@query(
    "input_delta",
    """WITH b AS (SELECT o_custkey AS k, count(*) || '|' || max(o_orderpriority) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-01' GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) || '|' || max(o_orderpriority) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-01' GROUP BY 1)
SELECT k, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change, b.v AS before, a.v AS after FROM b FULL JOIN a USING (k)""",
)
def input_delta(t):
    cut = F.lit("1998-04-01").cast("timestamp_ntz")
    side = lambda c: t.orders.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.concat_ws("|", F.count("*").cast("string"), F.max("o_orderpriority")).alias("v"))
    return R.delta(side(F.col("o_orderdate") < cut), side(F.col("o_orderdate") >= cut), ["k"], "v")


@query(
    "policy_diff",
    """WITH b AS (SELECT c_nationkey AS k, count(*) AS customers, max(c_mktsegment) AS segment FROM customer WHERE c_acctbal < 0 GROUP BY 1), a AS (SELECT c_nationkey AS k, count(*) AS customers, max(c_mktsegment) AS segment FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
SELECT k, 'customers' AS field, CAST(b.customers AS VARCHAR) AS before, CAST(a.customers AS VARCHAR) AS after FROM b JOIN a USING (k) WHERE b.customers <> a.customers UNION ALL SELECT k, 'segment', b.segment, a.segment FROM b JOIN a USING (k) WHERE b.segment IS DISTINCT FROM a.segment""",
)
def policy_diff(t):
    side = lambda c: t.customer.where(c).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.max("c_mktsegment").alias("segment"))
    return R.field_diff(side("c_acctbal < 0"), side("c_acctbal >= 0"), "k", ["customers", "segment"])


@query(
    "model_map",
    """WITH b AS (SELECT p_brand AS component, p_type AS state, CASE WHEN p_size > 25 THEN 'm' ELSE 'kg' END AS unit, p_name AS col FROM part),
c AS (SELECT DISTINCT p_brand AS component FROM part WHERE p_size > 3 UNION SELECT 'Brand#99'), s AS (SELECT DISTINCT p_type AS state, 'm' AS unit FROM part WHERE p_size > 20), k AS (SELECT DISTINCT p_name AS col FROM part WHERE p_size > 10)
SELECT finding, count(*) AS n FROM (SELECT 'component_without_binding' AS finding, component AS item FROM c WHERE component NOT IN (SELECT component FROM b) UNION ALL SELECT DISTINCT 'unknown_component', component FROM b WHERE component NOT IN (SELECT component FROM c)
 UNION ALL SELECT DISTINCT 'unknown_state', state FROM b WHERE state NOT IN (SELECT state FROM s) UNION ALL SELECT DISTINCT 'unit_differs', component FROM b JOIN s USING (state) WHERE b.unit <> s.unit UNION ALL SELECT DISTINCT 'missing_column', col FROM b WHERE col NOT IN (SELECT col FROM k) UNION ALL SELECT 'bound_twice', component FROM b GROUP BY component HAVING count(*) > 1) GROUP BY 1""",
)
def model_map(t):
    p = t.part
    b = p.select(F.col("p_brand").alias("component"), F.col("p_type").alias("state"), F.when(F.col("p_size") > 25, "m").otherwise("kg").alias("unit"), F.col("p_name").alias("column"))
    c = p.where("p_size > 3").select(F.col("p_brand").alias("component")).union(t.spark.range(1).select(F.lit("Brand#99"))).distinct()
    s = p.where("p_size > 20").select(F.col("p_type").alias("state"), F.lit("m").alias("unit")).distinct()
    k = p.where("p_size > 10").select(F.col("p_name").alias("column")).distinct()
    return R.check_model_map(b, c, s, k).groupBy("finding").agg(F.count("*").alias("n"))


@query(
    "parent_visits",
    """WITH r AS (SELECT l_suppkey AS s, l_orderkey AS o, list(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(o) OVER (PARTITION BY s ORDER BY o) AS parent FROM r)
SELECT c.s || '-' || c.o AS run, c.s || '-' || c.parent AS parent FROM p c JOIN r x ON x.s = c.s AND x.o = c.parent WHERE list_has_all(c.m, x.m)""",
)
def parent_visits(t):
    r = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.collect_set("l_returnflag").alias("manifest"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey")
    name = lambda c: F.concat_ws("-", F.col("l_suppkey").cast("string"), c.cast("string"))
    before = F.lag("l_orderkey").over(w)
    runs = r.select(name(F.col("l_orderkey")).alias("run"), F.when(before.isNotNull(), name(before)).alias("parent"), "manifest")
    return R.contained_successors(runs, "run", "parent", "manifest")


@query("registered_scopes", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS scopes FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def registered_scopes(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.count("*").alias("k"))
    return j.groupBy("c_mktsegment").agg(F.sum("k").alias("n"), F.count("*").alias("scopes"))


@query("blob_digests", "SELECT sha256(text) AS sha256, count(*) AS copies, CAST(min(strlen(text)) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_digests(t):
    return R.blobs(t.documents, "text").drop("content")


_TRIPLES = """SELECT 'c' || c_custkey AS subject, 'in' AS predicate, 'n' || c_nationkey AS object, false AS is_literal FROM customer UNION ALL SELECT 'c' || c_custkey, 'label', c_name || ' "' || c_mktsegment || '"', true FROM customer"""


def _literal_triples(t):
    c = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    row = lambda p, o, lit: F.struct(c.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(lit).alias("is_literal"))
    rows = F.array(row("in", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), False), row("label", F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('"')), True))
    return t.customer.select(F.explode(rows).alias("t")).select("t.*")


@query("turtle_lines", f"""SELECT '<{LIB}' || subject || '> <{LIB}' || predicate || '> ' || CASE WHEN is_literal THEN '"' || replace(object, '"', '\\"') || '"' ELSE '<{LIB}' || object || '>' END || ' .' AS line FROM ({_TRIPLES})""")
def turtle_lines(t):
    return R.to_turtle(_literal_triples(t), LIB)


@query("turtle_round_trip", _TRIPLES)
def turtle_round_trip(t):
    return R.from_turtle(R.to_turtle(_literal_triples(t), LIB), LIB)


@query("trace_export", f"WITH RECURSIVE {_P}, s(id, depth) AS (SELECT id, 0 FROM p WHERE id = 'r2' UNION ALL SELECT p.id, s.depth + 1 FROM p JOIN s ON p.parent = s.id WHERE s.depth < 12) SELECT id, CAST(depth AS INTEGER) AS depth, substr(id, 1, 1) AS kind FROM s WHERE substr(id, 1, 1) IN ('n', 'c')")
def trace_export(t):
    """Descendants to depth 12 of allowed kinds, allowed fields only."""
    p = forest(t)
    kind = F.substring("id", 1, 1)
    return G.descend(p, p.where("id = 'r2'").select("id"), t.spark, 12).where(kind.isin("n", "c")).select("id", "depth", kind.alias("kind"))


@query(
    "spec_projection",
    """SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT DISTINCT * FROM (SELECT 'n' || n_nationkey AS subject, unnest(['type', 'kind', 'label', 'scale']) AS predicate, unnest(['component', 'nation', n_name, CAST(n_regionkey AS VARCHAR)]) AS object FROM nation
 UNION ALL SELECT 'k' || c_custkey, unnest(['type', 'source', 'target', 'sign']), unnest(['coupling', 'n' || c_nationkey, 'n' || c_custkey % 25, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END]) FROM customer UNION ALL SELECT 'n' || c_nationkey, 'influences', 'n' || c_custkey % 25 FROM customer)) GROUP BY 1""",
)
def spec_projection(t):
    tag = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    n = t.nation.select(tag("n", F.col("n_nationkey")).alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("scale"))
    k = t.customer.select(tag("k", F.col("c_custkey")).alias("id"), tag("n", F.col("c_nationkey")).alias("source"), tag("n", F.col("c_custkey") % 25).alias("target"), F.when(F.col("c_acctbal") < 0, "-").otherwise("+").alias("sign"))
    return R.project_spec(n, k).groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(
    "contract_validation",
    """SELECT 'price' AS rule, count(*) AS n_rows, CAST(sum(CASE WHEN o_totalprice BETWEEN 0 AND 300000 THEN 0 ELSE 1 END) AS BIGINT) AS n_faults FROM orders UNION ALL SELECT 'status', count(*), CAST(sum(CASE WHEN trim(o_orderstatus) <> '' AND length(o_orderstatus) <= 1 THEN 0 ELSE 1 END) AS BIGINT) FROM orders
 UNION ALL SELECT 'words', count(*), CAST(sum(CASE WHEN len(string_split(o_orderpriority, '-')) <= 2 AND len(list_filter(string_split(o_orderpriority, '-'), lambda x: trim(x) = '')) = 0 THEN 0 ELSE 1 END) AS BIGINT) FROM orders""",
)
def contract_validation(t):
    rules = {"price": R.number(F.col("o_totalprice"), 0, 300000), "status": R.nonempty(F.col("o_orderstatus"), 1), "words": R.string_list(F.split("o_orderpriority", "-"), 2)}
    return R.faults(t.orders, rules)


@query("closed_props", "SELECT event_type, CAST(sum(CASE WHEN list_sort(json_keys(props)) = ['k'] THEN 0 ELSE 1 END) AS BIGINT) AS not_closed FROM events GROUP BY 1")
def closed_props(t):
    ok = R.closed(F.col("props"), ["k"])
    return t.events.groupBy("event_type").agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("not_closed"))


@query(
    "failure_classes",
    r"SELECT CASE WHEN regexp_extract(html, '([A-Z][A-Za-z]*(?:Error|Exception))', 1) <> '' THEN regexp_extract(html, '([A-Z][A-Za-z]*(?:Error|Exception))', 1) WHEN regexp_matches(html, '(?i)timed out|timeout') THEN 'timeout' WHEN regexp_matches(html, '(?i)\bfail(ed|ure)?\b') THEN 'failed' ELSE 'none' END AS class, count(*) AS n FROM pages GROUP BY 1",
)
def failure_classes(t):
    return t.pages.groupBy(R.failure_class(F.col("html")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "timestamp_offsets",
    """WITH s AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_type WHEN 'click' THEN 'Z' WHEN 'view' THEN '+05:30' WHEN 'error' THEN '-0330' ELSE '' END AS x FROM events), o AS (SELECT regexp_extract(x, '(Z|[+-]\\d\\d:?\\d\\d)$', 1) AS z FROM s)
SELECT z AS written, CAST(CASE WHEN z = 'Z' THEN 0 WHEN z <> '' THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 2) AS INTEGER) * 3600 + CAST(substr(regexp_replace(z, '[^0-9]', '', 'g'), 3, 2) AS INTEGER) * 60) END AS INTEGER) AS seconds, count(*) AS n FROM o GROUP BY 1, 2""".replace("\\\\", "\\"),
)
def timestamp_offsets(t):
    e = F.col("event_type")
    x = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e == "click", "Z").when(e == "view", "+05:30").when(e == "error", "-0330").otherwise(""))
    return t.events.select(x.alias("x")).groupBy(F.regexp_extract("x", R.OFFSET, 1).alias("written"), R.utc_offset(F.col("x")).alias("seconds")).agg(F.count("*").alias("n"))


@query(
    "time_axis",
    """WITH s AS (SELECT epoch(ts) AS ts, CAST(value AS DOUBLE) AS value, CAST(event_id * 2 AS DOUBLE) AS twice, lag(epoch(ts)) OVER w AS a, lag(CAST(value AS DOUBLE)) OVER w AS b, lag(CAST(event_id * 2 AS DOUBLE)) OVER w AS c FROM events WINDOW w AS (ORDER BY event_id)),
n AS (SELECT CAST(sum(CASE WHEN ts <= a THEN 1 ELSE 0 END) AS BIGINT) AS x, CAST(sum(CASE WHEN value <= b THEN 1 ELSE 0 END) AS BIGINT) AS y, CAST(sum(CASE WHEN twice <= c THEN 1 ELSE 0 END) AS BIGINT) AS z FROM s)
SELECT CAST(0 AS INTEGER) AS place, 'ts' AS candidate, x AS n_not_rising, x = 0 AS is_axis FROM n UNION ALL SELECT 1, 'value', y, x <> 0 AND y = 0 FROM n UNION ALL SELECT 2, 'twice', z, x <> 0 AND y <> 0 AND z = 0 FROM n""",
)
def time_axis(t):
    return R.time_axis(t.events.select("event_id", epoch("ts").alias("ts"), "value", (F.col("event_id") * 2).alias("twice")), "event_id", ["ts", "value", "twice"])


_NUM = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


@query("state_columns", "SELECT column_name, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS state FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS place, count(*) = count(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)) AS ok FROM supplier" for i, c in enumerate(_NUM)) + ") WHERE ok AND column_name <> 's_suppkey'")
def state_columns(t):
    place = F.create_map(*[F.lit(x) for i, c in enumerate(_NUM) for x in (c, i)])
    numeric = numeric_columns(t.supplier.select(*_NUM)).withColumn("place", place[F.col("column_name")])
    return R.state_columns(numeric, "s_suppkey")


@query("csv_context", "SELECT n_regionkey AS k, CAST(2 AS INTEGER) AS n_columns, CAST(count(*) AS INTEGER) AS n_rows, string_agg(n_nationkey || ';' || n_name, '|' ORDER BY n_nationkey) FILTER (WHERE i <= 5) AS shown, NULL::VARCHAR AS fault FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY 1")
def csv_context_query(t):
    line = F.struct("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    files = t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("r")).select("k", F.concat_ws("\n", F.lit("id,name"), F.array_join("r.line", "\n")).alias("csv"))
    out = csv_context(files, "k", "csv")
    return out.select("k", F.size("columns").alias("n_columns"), "n_rows", F.array_join(F.transform("sample", lambda r: F.array_join(r, ";")), "|").alias("shown"), "fault")


@query("catalog", "SELECT r_regionkey || '' AS domain, r_name AS title, n_nationkey || '' AS use_case, n_name AS use_case_title FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")
def catalog_query(t):
    case = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"))
    cases = t.nation.groupBy("n_regionkey").agg(F.collect_list(case).alias("use_cases"))
    domain = F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), "use_cases")
    doc = t.region.join(cases, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.to_json(F.struct(F.array(domain).alias("domains"))).alias("j"))
    return catalog(doc, "j")
