"""Scalar functions, sets, estimation aggregates and text on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..functions.units import UNITS, convert, parse_dimension, spell, unit_definitions
from ..operators import estimation as E
from ..operators.calibration import uniform
from ..operators.joins import normalize_name as normal
from ..operators.ordered import lagged
from ..operators.records import scene_frames
from ..operators.text import chunks, tfidf_search
from ..session import day, epoch, r6
from ..sources.readers import admit
from .base import query
from .scoring import rounded


_PACK = """r AS (SELECT o_orderkey AS id, o_custkey AS g, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'development' ELSE 'confirmation' END AS split, o_totalprice / 450000 AS price, epoch(o_orderdate) AS cutoff, epoch(o_orderdate) + (o_orderkey % 5) * 86400 AS resolved, epoch(o_orderdate) + 86400 * (1 - o_custkey % 9) AS event FROM orders),
g AS (SELECT g, count(DISTINCT split) AS s, count(DISTINCT cutoff) AS c FROM r GROUP BY 1), m AS (SELECT split, max(resolved) AS last, min(cutoff) AS first, count(DISTINCT g) AS n FROM r GROUP BY 1)"""


@query(
    "pit_admission",
    f"""WITH {_PACK}, f AS (SELECT r.split, unnest(list_filter([CASE WHEN NOT (price BETWEEN 0 AND 1) THEN 'price' END, CASE WHEN NOT cutoff < resolved THEN 'resolved_early' END, CASE WHEN NOT cutoff < event THEN 'event_early' END, CASE WHEN NOT (g.s = 1 AND g.c = 1) THEN 'mixed_group' END, CASE WHEN m.n < 2 THEN 'few_groups' END,
 CASE WHEN NOT coalesce((SELECT max(p.last) FROM m p WHERE p.split = CASE r.split WHEN 'development' THEN 'train' WHEN 'confirmation' THEN 'development' END) < m.first, true) THEN 'splits_overlap' END], lambda x: x IS NOT NULL)) AS fault FROM r JOIN g USING (g) JOIN m ON m.split = r.split)
SELECT split, fault, count(*) AS n FROM f GROUP BY 1, 2""",
)
def pit_admission(t):
    """Orders as rows of a pack, customers as its event groups, through the admission rules."""
    at = lambda days: F.date_format((F.col("o_orderdate").cast("timestamp").cast("long") + 86400 * days).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "P", "development").otherwise("confirmation")
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("event_group"), split.alias("split"), F.lit("above the line").alias("contract"), F.lit("line").alias("source_span"),
        F.lit("greater_than").alias("predicate"), F.lit("USD").alias("unit"), (F.col("o_totalprice") / 450000).alias("price"), F.lit(1).alias("label"), at(F.lit(-1)).alias("rules_available_at"), at(F.lit(-1)).alias("observed_at"),
        at(F.lit(0)).alias("available_at"), at(F.lit(0)).alias("cutoff"), at(F.col("o_orderkey") % 5).alias("resolved_at"), at(1 - F.col("o_custkey") % 9).alias("event_time"),
    )
    return admit(rows).select("split", F.explode("faults").alias("fault")).groupBy("split", "fault").agg(F.count("*").alias("n"))


@query("expr_eval", "SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 25 AND l_tax < 0.05 THEN least(greatest(l_extendedprice * (1 - l_discount), 1000), 60000) ELSE sqrt(l_extendedprice) END), 2) AS total, round(max(ln(l_quantity + 1) * pow(l_discount, 2)), 6) AS top FROM lineitem GROUP BY 1")
def expr_eval(t):
    names = {n: F.col(f"l_{c}") for n, c in (("q", "quantity"), ("p", "extendedprice"), ("d", "discount"), ("x", "tax"))}
    total = compile_expression("where(q > 25 and x < 0.05, clip(p * (1 - d), 1000, 60000), sqrt(p))", names)
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(total), 2).alias("total"), r6(F.max(compile_expression("log(q + 1) * d ** 2", names))).alias("top"))


@query("text_page", "SELECT doc_id, substr(text, 101, 80) AS page, CASE WHEN length(text) > 180 THEN CAST(180 AS INTEGER) END AS next_offset, length(text) > 180 AS truncated FROM documents")
def text_page(t):
    n = F.length("text")
    return t.documents.select("doc_id", F.substring("text", 101, 80).alias("page"), F.when(n > 180, 180).alias("next_offset"), (n > 180).alias("truncated"))


@query(
    "scenario_long",
    "SELECT 'base' AS scenario, CAST(l_linenumber - 1 AS INTEGER) AS step, 'quantity' AS state, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 'base', CAST(l_linenumber - 1 AS INTEGER), 'tax', round(avg(l_tax), 6) FROM lineitem GROUP BY l_linenumber",
)
def scenario_long(t):
    step = t.lineitem.groupBy("l_linenumber").agg(F.create_map(F.lit("quantity"), F.avg("l_quantity"), F.lit("tax"), F.avg("l_tax")).alias("states"))
    report = step.groupBy(F.lit("base").alias("scenario")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.map_entries("states").alias("e")))), lambda x: x["e"]).alias("steps"))
    return report.select("scenario", F.posexplode("steps").alias("step", "e")).select("scenario", "step", F.explode("e").alias("s")).select("scenario", "step", F.col("s.key").alias("state"), r6(F.col("s.value")).alias("value"))


@query(
    "tfidf_search",
    r"""WITH c AS (SELECT doc_id, o AS "offset", substr(text, o + 1, 1100) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) AS o FROM documents WHERE length(text) > 0)),
w AS (SELECT doc_id, "offset", unnest(regexp_extract_all(lower(chunk), '[\p{L}\p{N}_]{2,}')) AS w FROM c), q AS (SELECT w, 1 + ln(count(*)) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('the thing is here and there by name'), '[\p{L}\p{N}_]{2,}')) AS w) GROUP BY 1),
tf AS (SELECT doc_id, "offset", w, 1 + ln(count(*)) AS tf FROM w GROUP BY 1, 2, 3), n AS (SELECT count(*) + 1 AS n FROM c), d AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
i AS (SELECT coalesce(d.w, q.w) AS w, 1 + ln((1 + n) / CAST(1 + coalesce(df, 0) + CASE WHEN q.w IS NULL THEN 0 ELSE 1 END AS DOUBLE)) AS idf, qtf FROM d FULL JOIN q ON d.w = q.w, n),
s AS (SELECT doc_id, "offset", sum(tf * idf * qtf * idf) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN i ON i.w = tf.w GROUP BY 1, 2), z AS (SELECT sqrt(sum(qtf * idf * qtf * idf)) AS qn FROM i)
SELECT doc_id, CAST("offset" AS INTEGER) AS "offset", round(dot / (norm * qn), 6) AS score FROM s, z WHERE dot > 0 ORDER BY score DESC, doc_id, "offset" LIMIT 10""",
)
def tfidf_query(t):
    return tfidf_search(chunks(t.documents, "doc_id", "text"), "the thing is here and there by name", "doc_id")


@query(
    "stratified_round_robin",
    "WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events) SELECT event_type, event_id, CAST(row_number() OVER (ORDER BY i, event_type) AS INTEGER) AS position FROM k WHERE i <= 4",
)
def stratified_round_robin(t):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    top = t.events.withColumn("i", F.row_number().over(w)).where("i <= 4")  # few rows per stratum, so the last order is small
    return top.select("event_type", "event_id", F.row_number().over(Window.orderBy("i", "event_type")).alias("position"))


@query(
    "key_set_ops",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left_only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'right_only', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""",
)
def key_set_ops(t):
    # one pass: which sides a key is on, then counts
    f, u = F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u")
    n = t.orders.groupBy("o_custkey").agg(f, u).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in (("both", "f AND u"), ("left_only", "f AND NOT u"), ("right_only", "u AND NOT f"), ("union", "f OR u"))])
    return n.unpivot([], ["both", "left_only", "right_only", "union"], "part", "n")


@query("coverage_equality", "SELECT count(*) AS n_keys, CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, sum(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 ELSE 0 END) = 0 AS equal FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k")
def coverage_equality(t):
    a, b = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a")).distinct(), t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit(1).alias("b")).distinct()
    return a.join(b, "k", "full").agg(F.count("*").alias("n_keys"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("equal"))


@query("dedupe_links", "SELECT l_suppkey, count(*) AS links FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1")
def dedupe_links(t):
    return t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct().groupBy("l_suppkey").agg(F.count("*").alias("links"))


@query("normalize_name", "SELECT c_custkey, substr(trim(regexp_replace(lower(c_name || ', ' || c_mktsegment || ' & Co.'), '[^0-9a-z]+', ' ', 'g')), 1, 200) AS normal FROM customer")
def normalize_name(t):
    return t.customer.select("c_custkey", normal(F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" & Co."))).alias("normal"))


@query("stable_ids", "SELECT doc_id, 'src_' || substr(sha256(source || '|' || text), 1, 16) AS stable_id FROM documents")
def stable_ids(t):
    return t.documents.select("doc_id", F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", "source", "text"), 256), 1, 16)).alias("stable_id"))


@query("url_params", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '[?&](utm_source|token|key|sig)=') AS has_marked_param, CAST(length(url) - length(replace(url, '=', '')) AS INTEGER) AS n_params FROM pages")
def url_params(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.col("url").rlike("[?&](utm_source|token|key|sig)=").alias("has_marked_param"), (F.length("url") - F.length(F.replace("url", F.lit("="), F.lit("")))).alias("n_params"))


@query("age_weight", "SELECT o_orderpriority, round(avg(least(1, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) / CAST(365 AS DOUBLE))), 6) AS weight FROM orders GROUP BY 1")
def age_weight(t):
    age = F.greatest(F.lit(0), F.unix_date(F.lit("2001-08-01").cast("date")) - day("o_orderdate")) / 365
    return rounded(t.orders.groupBy("o_orderpriority").agg(F.avg(F.least(F.lit(1.0), age)).alias("weight")), "weight")


@query(
    "shrinkage_calibrator",
    """WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, o_totalprice / 500000 AS p FROM orders), b AS (SELECT avg(y) AS base FROM r), a AS (SELECT least(1, greatest(0, sum((y - p) * (base - p)) / sum((base - p) * (base - p)))) AS alpha FROM r, b)
SELECT round(alpha, 6) AS alpha, round(base, 6) AS base, round(avg((p + alpha * (base - p) - y) * (p + alpha * (base - p) - y)), 6) AS brier FROM r, b, a GROUP BY alpha, base""",
)
def shrinkage_calibrator(t):
    r = t.orders.select(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"), (F.col("o_totalprice") / 500000).alias("p"))
    m = r.agg(*[F.avg(c).alias(k) for k, c in (("y", F.col("y")), ("p", F.col("p")), ("yp", F.col("y") * F.col("p")), ("pp", F.col("p") * F.col("p")), ("yy", F.col("y") * F.col("y")))])  # five moments, one pass
    b, p = F.col("y"), F.col("p")
    num, den = b * b - b * p - F.col("yp") + F.col("pp"), b * b - 2 * b * p + F.col("pp")
    m = m.withColumn("alpha", F.least(F.lit(1.0), F.greatest(F.lit(0.0), num / den)))
    k = 1 - F.col("alpha")
    c = F.col("alpha") * b
    brier = k * k * F.col("pp") + c * c + F.col("yy") + 2 * k * c * p - 2 * k * F.col("yp") - 2 * c * b
    return rounded(m.select("alpha", b.alias("base"), brier.alias("brier")), "alpha", "base", "brier")


@query(
    "erlang",
    """WITH RECURSIVE l AS (SELECT n_nationkey AS k, 1 + n_nationkey % 5 * CAST(0.7 AS DOUBLE) AS a, 4 + n_nationkey % 3 AS c FROM nation), b(k, a, c, i, x) AS (SELECT k, a, c, 0, CAST(1 AS DOUBLE) FROM l UNION ALL SELECT k, a, c, i + 1, a * x / (i + 1 + a * x) FROM b WHERE i < c)
SELECT k, round(a, 6) AS load, CAST(c AS INTEGER) AS servers, round(x, 8) AS erlang_b, round(x / (1 - a / c * (1 - x)), 8) AS erlang_c FROM b WHERE i = c""",
)
def erlang(t):
    k = F.col("n_nationkey")
    load, servers = 1 + k % 5 * 0.7, (4 + k % 3).cast("int")
    return t.nation.select(k.alias("k"), r6(load).alias("load"), servers.alias("servers"), F.round(E.erlang_b(load, servers), 8).alias("erlang_b"), F.round(E.erlang_c(load, servers), 8).alias("erlang_c"))


@query("crn_uniform", "SELECT c_custkey, round(('0x' || substr(sha256('7|' || c_custkey || '|demand'), 1, 12))::BIGINT / CAST(281474976710656 AS DOUBLE), 9) AS u FROM customer")
def crn_uniform(t):
    return t.customer.select("c_custkey", F.round(uniform("7", F.col("c_custkey"), "demand"), 9).alias("u"))


@query(
    "unit_convert",
    """SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * CAST(0.01 AS DOUBLE) WHEN 2 THEN p_size * CAST(0.001 AS DOUBLE) END, 6) AS metres FROM part""",
)
def unit_convert(t):
    unit = F.when(F.col("p_size") % 4 == 0, "km").when(F.col("p_size") % 4 == 1, "cm").when(F.col("p_size") % 4 == 2, "mm").otherwise("kg")
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("v"), unit.alias("u"), F.lit("m").alias("target"))
    return convert(rows, "v", "u", "target").select("p_partkey", r6(F.col("converted")).alias("metres"))


@query(
    "unit_harmonise",
    """SELECT event_type, count(*) AS n, round(avg(CASE event_type WHEN 'click' THEN (value - 32) * 5 / CAST(9 AS DOUBLE) WHEN 'view' THEN value - 273.15 ELSE value END), 6) AS mean_deg_c, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events) GROUP BY 1""",
)
def unit_harmonise(t):
    """Every row has its own unit; a unit of another dimension is refused."""
    e = F.col("event_type")
    rows = t.events.select("event_type", "value", F.when(e == "click", "deg_f").when(e == "view", "K").when(e == "error", "kg").otherwise("degC").alias("u"), F.lit("deg_c").alias("target"))
    out = convert(rows, "value", "u", "target").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("converted").alias("mean_deg_c"), F.count_if(F.col("converted").isNull()).alias("refused"))
    return rounded(out, "mean_deg_c")


@query(
    "unit_definitions",
    "SELECT dimension, count(*) AS n, CAST(max(k) AS BIGINT) AS most_equivalent FROM (SELECT dimension, scale, o, count(*) AS k FROM (VALUES " + ", ".join(f"('{spell(parse_dimension(d))}', CAST({s!r} AS DOUBLE), CAST({o!r} AS DOUBLE))" for _, _, d, s, o in UNITS) + ") v(dimension, scale, o) GROUP BY 1, 2, 3) GROUP BY 1",
)
def unit_definitions_query(t):
    return unit_definitions(t.spark).select("dimension", "scale", "offset", "equivalent").distinct().groupBy("dimension").agg(F.count("*").alias("n"), F.max("equivalent").alias("most_equivalent"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN json_extract_string(props, '$.missing') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without FROM events GROUP BY 1")
def json_props(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("without"))


@query("normal_equations", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS sx, round(sum(l_tax), 4) AS sz, round(sum(l_quantity * l_quantity), 2) AS sxx, round(sum(l_quantity * l_tax), 4) AS sxz, round(sum(l_tax * l_tax), 6) AS szz, round(sum(l_quantity * l_discount), 4) AS sxy, round(sum(l_tax * l_discount), 6) AS szy FROM lineitem")
def normal_equations(t):
    gram, b, _, n = E.moments(t.lineitem, ["l_quantity", "l_tax"], "l_discount")
    row = (n, round(gram[0, 1], 2), round(gram[0, 2], 4), round(gram[1, 1], 2), round(gram[1, 2], 4), round(gram[2, 2], 6), round(b[1], 4), round(b[2], 6))
    return t.spark.createDataFrame([tuple([row[0], *map(float, row[1:])])], "n long, sx double, sz double, sxx double, sxz double, szz double, sxy double, szy double")


@query(
    "scene_frames",
    """WITH a AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS frame, user_id AS agent, avg(value) AS x, count(*) AS y FROM events GROUP BY 1, 2)
SELECT frame, agent, round(x, 6) AS x, y, CAST(row_number() OVER (PARTITION BY frame ORDER BY agent) AS INTEGER) AS place, count(*) OVER (PARTITION BY frame) AS agents FROM a""",
)
def scene_frames_query(t):
    a = t.events.groupBy(day("ts").alias("frame"), F.col("user_id").alias("agent")).agg(F.avg("value").alias("x"), F.count("*").alias("y"))
    return rounded(scene_frames(a, "frame", "agent", ["x", "y"]), "x")


@query("linear_fit", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(t):
    out = E.linear_fit(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(rounded(out, "slope", "intercept", places=4), "r2", places=8)


@query(
    "elementary_effects",
    """WITH e AS (SELECT event_type AS factor, (value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 10 AS d FROM events) SELECT factor, round(avg(d), 6) AS mu, round(avg(abs(d)), 6) AS mu_star, round(stddev_samp(d), 6) AS sigma FROM e WHERE d IS NOT NULL GROUP BY 1""",
)
def elementary_effects(t):
    rows = t.events.select(F.col("event_type").alias("factor"), epoch("ts").alias("at"), "event_id", "value")
    e = lagged(rows, ["factor"], "at", ["event_id"], {"before": "value"}).select("factor", ((F.col("value") - F.col("before")) / 10).alias("d")).where("d IS NOT NULL")
    return rounded(e.groupBy("factor").agg(F.avg("d").alias("mu"), F.avg(F.abs("d")).alias("mu_star"), F.stddev_samp("d").alias("sigma")), "mu", "mu_star", "sigma")


@query(
    "sobol_estimator",
    """WITH d AS (SELECT l_linenumber AS factor, l_quantity AS a, l_quantity * (1 + l_tax) AS b, l_quantity * (1 + l_discount) AS ab FROM lineitem)
SELECT CAST(factor AS INTEGER) AS factor, round(avg(b * (ab - a)) / var_pop(a), 6) AS first_order, round(avg((a - ab) * (a - ab)) / (2 * var_pop(a)), 6) AS total FROM d GROUP BY factor""",
)
def sobol_estimator(t):
    a, b, ab = F.col("l_quantity"), F.col("l_quantity") * (1 + F.col("l_tax")), F.col("l_quantity") * (1 + F.col("l_discount"))
    return rounded(t.lineitem.groupBy(F.col("l_linenumber").alias("factor")).agg((F.avg(b * (ab - a)) / F.var_pop(a)).alias("first_order"), (F.avg((a - ab) ** 2) / (2 * F.var_pop(a))).alias("total")), "first_order", "total")


@query("poly_library", "SELECT p_partkey, CAST(1 AS DOUBLE) AS one, CAST(p_size AS DOUBLE) AS x, round(p_retailprice / 1000, 6) AS y, CAST(p_size * p_size AS DOUBLE) AS x2, round(p_size * p_retailprice / 1000, 6) AS xy, round(pow(p_retailprice / 1000, 2), 6) AS y2, round(sin(p_size), 6) AS sin_x FROM part")
def poly_library(t):
    terms = E.power_terms({"x": F.col("p_size").cast("double"), "y": F.col("p_retailprice") / 1000}, 2, trig=True)
    names = {"one": "one", "x": "x", "y": "y", "x*x": "x2", "x*y": "xy", "y*y": "y2", "sin(x)": "sin_x"}
    return rounded(t.part.select("p_partkey", *[terms[k].alias(n) for k, n in names.items()]), "y", "xy", "y2", "sin_x")


@query(
    "support_box",
    """WITH b AS (SELECT min(p_size) AS a, max(p_size) AS z, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_type = 'ECONOMY'),
s AS (SELECT CASE WHEN p_size < a OR p_size > z OR p_retailprice < c OR p_retailprice > d THEN 'extrapolation' WHEN p_size < a + CAST(0.05 AS DOUBLE) * (z - a) OR p_size > z - CAST(0.05 AS DOUBLE) * (z - a) OR p_retailprice < c + CAST(0.05 AS DOUBLE) * (d - c) OR p_retailprice > d - CAST(0.05 AS DOUBLE) * (d - c) THEN 'boundary' ELSE 'interior' END AS support FROM part, b) SELECT support, count(*) AS n FROM s GROUP BY 1""",
)
def support_box(t):
    return E.support(t.part, t.part.where("p_type = 'ECONOMY'"), ["p_size", "p_retailprice"]).groupBy("support").agg(F.count("*").alias("n"))


@query(
    "shrunken_rate",
    """WITH f AS (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS fleet FROM events), g AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS hits FROM events GROUP BY 1) SELECT user_id, n, round((hits + 4 * fleet) / (n + 4), 6) AS rate FROM g, f""",
)
def shrunken_rate(t):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("hits"))
    fleet = g.agg((F.sum("hits") / F.sum("n")).alias("fleet"))  # one row
    return g.crossJoin(fleet).select("user_id", "n", r6((F.col("hits") + 4 * F.col("fleet")) / (F.col("n") + 4)).alias("rate"))
