"""Joins with a report, and joins that plain SQL does not name.

Nothing here forces a physical strategy: sides are aggregated before they are
joined where only counts matter, bands are equi joins on an exploded offset, and
as-of lookups are window fills over a union instead of range joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import lagged

BLOWUP, MAJORITY, MINOR, NEAR_SHOWN = 2.0, 0.5, 0.1, 32


def join_risk(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: what an inner join on the keys would do, and how risky that is."""
    is_text = lambda df, k: df.schema[k].dataType.typeName() == "string"
    mismatch = is_text(left, left_key) != is_text(right, right_key)

    def side(df: DataFrame, key: str, n: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias(n))

    blank = F.col("k").isNull() | (F.trim("k") == "")
    l, r = side(left, left_key, "lc"), side(right, right_key, "rc")
    both = l.where(~blank).join(r.where(~blank), "k", "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hit = F.col("lc").isNotNull() & F.col("rc").isNotNull()
    if mismatch:
        hit = F.lit(False)
    fold = F.lower(F.trim("k"))
    near = None
    if is_text(left, left_key) and is_text(right, right_key):
        missed = both.where("lc IS NULL").select("k", fold.alias("f")).join(l.where(~blank).select(fold.alias("f")).distinct(), "f", "left_semi").select("k")
        # the first few are kept by every task, so no row holds all of them
        shown = missed.orderBy("k").limit(NEAR_SHOWN).agg(F.sort_array(F.collect_list("k")).alias("near_shown"))
        near = missed.agg(F.count("*").alias("near_misses")).crossJoin(shown)  # one row each
    out = both.agg(
        F.count("lc").alias("left_keys"), F.count("rc").alias("right_keys"), F.count_if(hit).alias("matched_keys"),
        n(F.when(hit, F.col("lc") * F.col("rc"))).alias("output_rows"), F.coalesce(F.max("lc"), F.lit(0)).alias("left_fanout"), F.coalesce(F.max("rc"), F.lit(0)).alias("right_fanout"),
        n(F.when(~hit, F.col("lc"))).alias("left_unmatched_rows"), n(F.when(~hit, F.col("rc"))).alias("right_unmatched_rows"), n("lc").alias("lk"), n("rc").alias("rk"),
    )
    blanks = lambda df, c, name: df.agg(n(F.when(blank, F.col(c))).alias(name))
    out = out.crossJoin(blanks(l, "lc", "left_blank")).crossJoin(blanks(r, "rc", "right_blank"))  # one row each
    out = out.crossJoin(near) if near is not None else out.withColumns({"near_misses": F.lit(0).cast("long"), "near_shown": F.array().cast("array<string>")})
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    out = out.withColumns({"left_rows": F.col("lk") + F.col("left_blank"), "right_rows": F.col("rk") + F.col("right_blank")})
    out = out.withColumns(
        {
            "max_fanout_product": F.col("left_fanout") * F.col("right_fanout"),
            "left_unmatched_fraction": share("left_unmatched_rows", "left_rows"),
            "right_unmatched_fraction": share("right_unmatched_rows", "right_rows"),
            "blowup": F.when(F.col("left_rows") == 0, 0.0).otherwise(F.round(F.col("output_rows") / F.col("left_rows"), 6)),
            "cardinality": F.when((F.col("left_keys") == 0) | (F.col("right_keys") == 0), "empty")
            .when((F.col("left_fanout") == 1) & (F.col("right_fanout") == 1), "one_to_one")
            .when(F.col("left_fanout") == 1, "one_to_many").when(F.col("right_fanout") == 1, "many_to_one").otherwise("many_to_many"),
        }
    )
    worst = F.greatest("left_unmatched_fraction", "right_unmatched_fraction")
    many = F.col("cardinality") == "many_to_many"
    reasons = [
        (F.lit(mismatch), "key_type_mismatch"), (F.col("matched_keys") == 0, "no_matching_keys"), (many, "many_to_many_cardinality"), (F.col("blowup") > BLOWUP, "row_blowup_above_2x"),
        (worst > MAJORITY, "majority_unmatched"), (F.col("left_blank") + F.col("right_blank") > 0, "null_or_missing_keys"),
        (F.col("near_misses") > 0, "case_or_whitespace_near_misses"), ((worst > MINOR) & (worst <= MAJORITY), "unmatched_above_10_percent"),
    ]
    out = out.withColumn("reasons", F.concat_ws(",", *[F.when(c, F.lit(name)) for c, name in reasons]))
    risk = F.when(F.lit(mismatch) | (F.col("matched_keys") == 0), "blocked").when(many | (F.col("blowup") > BLOWUP) | (worst > MAJORITY), "high").when(F.col("reasons") != "", "elevated").otherwise("low")
    return out.withColumn("risk", risk).drop("lk", "rk")


def normalize_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " ")), 1, 200)


# Articles and legal suffixes that do not tell names apart.
STOP = "a an the of and inc incorporated llc ltd limited corp corporation co company plc gmbh ag sa bv nv sas srl pty".split()


def name_tokens(normal: Column) -> Column:
    every = F.array_distinct(F.filter(F.split(normal, " "), lambda x: x != ""))
    kept = F.array_except(every, F.array(*map(F.lit, STOP)))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def align_entities(left: DataFrame, right: DataFrame, match: float = 0.90, ambiguous: float = 0.60, margin: float = 0.02) -> DataFrame:
    """(id, name) on both sides to one row per left id: status, best right id, score.

    Score: half token Jaccard, half edit similarity.  Pairs without a common token
    score at most 0.5, below every threshold, so an equi join on tokens loses none.
    """
    if ambiguous <= 0.5:
        raise ValueError("pairs without a common token could score that high")

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{p}_id"), normalize_name("name").alias(f"{p}_name")).withColumn(f"{p}_tokens", name_tokens(F.col(f"{p}_name")))

    l, r = side(left, "l"), side(right, "r")
    pairs = l.withColumn("k", F.explode("l_tokens")).join(r.withColumn("k", F.explode("r_tokens")), "k").dropDuplicates(["l_id", "r_id"])
    jaccard = F.size(F.array_intersect("l_tokens", "r_tokens")) / F.size(F.array_union("l_tokens", "r_tokens"))
    edit = 1 - F.levenshtein("l_name", "r_name") / F.greatest(F.length("l_name"), F.length("r_name"), F.lit(1))
    scored = pairs.select("l_id", "r_id", F.round(0.5 * jaccard + 0.5 * edit, 6).alias("score")).where(F.col("score") >= ambiguous)
    w = Window.partitionBy("l_id").orderBy(F.desc("score"), "r_id")
    best = scored.withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w), "n": F.count("*").over(Window.partitionBy("l_id"))}).where("k = 1")
    tied = F.coalesce(F.col("score") - F.col("next") <= margin, F.lit(False))
    best = best.withColumn("strong", (F.col("score") >= match) & ~tied)
    claims = best.where("strong").groupBy("r_id").agg(F.count("*").alias("claims"))
    out = l.select("l_id").join(best, "l_id", "left").join(claims, "r_id", "left")
    status = F.when(F.col("score").isNull(), "unmatched").when(F.col("strong") & (F.col("claims") == 1), "matched").otherwise("ambiguous")
    return out.select(F.col("l_id").alias("left_id"), status.alias("status"), F.col("r_id").alias("best_id"), "score", F.coalesce("n", F.lit(0)).alias("n_candidates"))


QUARTER = 900  # Fixed value: a constant shift by whole quarter hours looks like a clock
COVERED = 0.999  # Fixed value: share of a span below which coverage is a warning


def align_time(points: DataFrame, series: str, t: str, ties: Sequence[str], bucket: float = 3600.0) -> DataFrame:
    """Profile of every series against the support that all share, and whether they line up.

    Count, ends, span, distinct and modal step (the first seen of equals), repeated times,
    share of the span inside the common support, and a verdict: blocked, resample_required,
    aligned_as_declared.
    """
    s = lagged(points.select(series, t, *ties), [series], t, ties, {"_was": t}, bucket).withColumn("step", F.col(t) - F.col("_was"))
    steps = s.groupBy(series, "step").agg(F.count("*").alias("k"), F.min(t).alias("_first"))
    modal = steps.where("step > 0").groupBy(series).agg(F.min_by("step", F.struct(-F.col("k"), F.col("_first"))).alias("modal_step"), F.count("*").alias("n_steps"))
    again = steps.where("step = 0").select(series, F.col("k").alias("duplicate_times"))
    p = points.groupBy(series).agg(F.count("*").alias("n"), F.min(t).alias("start_at"), F.max(t).alias("end_at"), (F.max(t) - F.min(t)).alias("span"))
    shared = p.agg(F.max("start_at").alias("a"), F.min("end_at").alias("b"))  # one row
    verdict = F.when(F.col("b") < F.col("a"), "blocked").when(F.col("n_steps") == 1, "aligned_as_declared").otherwise("resample_required")
    out = p.join(modal, series).join(again, series, "left").crossJoin(shared)
    coverage = F.greatest(F.lit(0), F.col("b") - F.col("a")) / F.col("span")
    return out.select(*p.columns, "n_steps", F.coalesce("duplicate_times", F.lit(0)).alias("duplicate_times"), "modal_step", (F.col("n_steps") == 1).alias("regular"), coverage.alias("coverage"), verdict.alias("verdict"))


def clock_findings(left: DataFrame, right: DataFrame, t: str = "t") -> DataFrame:
    """(finding, seconds) of two series of times that should be the same: shift, declared zone, coverage.

    ``t`` are seconds and ``zone`` the declared offset; the k-th times are compared.  Finding
    codes: suspected_clock_shift for one constant offset of whole quarter hours,
    declared_timezone_mismatch, constant_offset, low_coverage.
    """
    number = lambda df, n: df.select(F.col(t).alias(n), F.col("zone").alias(f"zone_{n}"), F.row_number().over(Window.orderBy(t)).alias("k"))
    pairs = number(left, "l").join(number(right, "r"), "k")  # two series of times, in one order each
    gap = F.col("r") - F.col("l")
    one = pairs.agg(F.min(gap).alias("low"), F.max(gap).alias("high"), F.max("zone_l").alias("zl"), F.max("zone_r").alias("zr"), F.max("r").alias("re"), F.min("r").alias("rs"), F.max("l").alias("le"), F.min("l").alias("ls"))
    constant = (F.col("low") == F.col("high")) & (F.col("low") != 0)
    covered = (F.least("re", "le") - F.greatest("rs", "ls")) / F.nullif(F.least(F.col("re") - F.col("rs"), F.col("le") - F.col("ls")), F.lit(0))
    found = [(constant, "constant_offset", "low"), (constant & (F.col("low") % QUARTER == 0), "suspected_clock_shift", "low"), (F.col("zl") != F.col("zr"), "declared_timezone_mismatch", "low"), (F.coalesce(covered < COVERED, F.lit(False)), "low_coverage", "low")]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("finding"), F.col(v).cast("double").alias("seconds"))) for c, name, v in found]))
    return one.select(F.explode(rows).alias("f")).select("f.*")


def adjacent(df: DataFrame, key: Sequence[str], threshold: str, ties: Sequence[str], value: str) -> DataFrame:
    """Neighbours by threshold inside a key, where it strictly rises: is value_high <= value_low?"""
    w = Window.partitionBy(*key).orderBy(threshold, *ties)
    out = df.withColumns({"low": F.col(threshold), "high": F.lead(threshold).over(w), "v_low": F.col(value), "v_high": F.lead(value).over(w)})
    return out.where("high > low").select(*key, "low", "high", (F.col("v_high") <= F.col("v_low")).alias("coherent"))


def best_lag(series: DataFrame, base: str, lags: range = range(-5, 6), least: int = 12, sigma: float = 1e-6) -> DataFrame:
    """(series, t, v): per other series the lag with the highest correlation to ``base``; the first best wins."""
    a = series.where(F.col("series") == base).select(F.col("t").alias("t0"), F.col("v").alias("x"))
    b = series.where(F.col("series") != base).select("series", "t", F.col("v").alias("y"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    pairs = b.withColumn("t0", F.col("t") - F.col("lag")).join(a, "t0")
    m = pairs.groupBy("series", "lag").agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in (("mx", F.col("x")), ("my", F.col("y")), ("mxx", F.col("x") * F.col("x")), ("myy", F.col("y") * F.col("y")), ("mxy", F.col("x") * F.col("y")))])
    sx, sy = (F.sqrt(F.greatest(F.lit(0.0), F.col(f"m{c}{c}") - F.col(f"m{c}") * F.col(f"m{c}"))) for c in "xy")
    m = m.withColumns({"sx": sx, "sy": sy}).where((F.col("n") >= least) & (F.col("sx") > sigma) & (F.col("sy") > sigma))
    m = m.withColumn("r", F.round((F.col("mxy") - F.col("mx") * F.col("my")) / (F.col("sx") * F.col("sy")), 6))
    w = Window.partitionBy("series").orderBy(F.desc("r"), "lag")
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").select("series", "lag", "n", "r")


def interpolate(series: DataFrame, at: DataFrame, key: Sequence[str], bucket: float | None = None) -> DataFrame:
    """(key, t, v) looked up at (key, t, id): linear between neighbours, clamped at the ends.

    One union and two window fills per key, both from the start of a window in its own direction
    (a frame up to the end of a window is computed anew for every row): no range join.  For few
    keys with many rows, ``bucket`` cuts keys into windows of so many units of ``t``; the points
    around a bucket come from one row per bucket.
    """
    rows = series.select(*key, "t", "v", F.lit(None).cast("long").alias("id")).unionByName(at.select(*key, "t", F.lit(None).cast("double").alias("v"), "id"))
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    cut = [*key, "_bucket"] if bucket else [*key]
    if bucket:
        rows = rows.withColumn("_bucket", F.coalesce(F.floor(F.col("t") / bucket), F.lit(2**62)))  # rows without a time come last
    null = F.col("v").isNull()
    ahead = Window.partitionBy(*cut).orderBy(F.asc_nulls_last("t"), null, "v", "id")
    back = Window.partitionBy(*cut).orderBy(F.desc_nulls_first("t"), null.desc(), F.desc("v"), F.desc("id"))
    upto = (Window.unboundedPreceding, 0)
    found = rows.withColumns({"p": F.last(point, True).over(ahead.rowsBetween(*upto)), "q": F.last(point, True).over(back.rowsBetween(*upto))}).where("id IS NOT NULL")
    if bucket:
        order = F.struct(F.col("t").isNull().alias("last"), "t", "v")
        held = rows.groupBy(*cut).agg(F.max_by(point, F.when(~null, order)).alias("_p"), F.min_by(point, F.when(~null, order)).alias("_q"))  # one row per bucket
        w, before = Window.partitionBy(*key), (Window.unboundedPreceding, -1)
        p, q = F.last("_p", True).over(w.orderBy("_bucket").rowsBetween(*before)), F.last("_q", True).over(w.orderBy(F.desc("_bucket")).rowsBetween(*before))
        held = held.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cut)], p.alias("_p"), q.alias("_q"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cut)])
        found = found.join(held, same).withColumns({"p": F.coalesce("p", "_p"), "q": F.coalesce("q", "_q")})
    slope = (F.col("q.v") - F.col("p.v")) / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0.0))
    y = F.coalesce(F.col("p.v") + slope * (F.col("t") - F.col("p.t")), F.col("p.v"), F.col("q.v"))
    return found.select(*key, "id", "t", y.alias("y"))


def pareto(df: DataFrame, keep: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows that no other row dominates (both greater or equal, one greater).

    Each partition is reduced to its own front, so the last step sees few rows.
    """
    df = df.select(*keep, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(), pdf[y].to_numpy()
        order = np.lexsort((-b, -a))
        best, out = -np.inf, []
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and a[order[j]] == a[order[i]]:
                j += 1
            if b[order[i]] > best:
                best = b[order[i]]
                out += [k for k in order[i:j] if b[k] == best]
            i = j
        return pdf.iloc[out]

    def local(batches):
        held = None
        for pdf in batches:
            held = front(pdf if held is None else pd.concat([held, pdf]))
        if held is not None:
            yield held

    few = df.mapInPandas(local, df.schema)
    return few.repartition(1).mapInPandas(local, df.schema)  # a shuffle, so the scan keeps its tasks


def snapshot_diff(before: DataFrame, after: DataFrame, key: Sequence[str], kind: str, mass: str) -> DataFrame:
    """Per kind: items resolved, new and unchanged, and the mass on both sides."""
    b, a = before.select(*key, F.col(mass).alias("mb")), after.select(*key, F.col(mass).alias("ma"))
    both = b.join(a, list(key), "full")
    return both.groupBy(kind).agg(
        F.count_if(F.expr("ma IS NULL")).alias("resolved"), F.count_if(F.expr("mb IS NULL")).alias("new"), F.count_if(F.expr("ma IS NOT NULL AND mb IS NOT NULL")).alias("unchanged"),
        F.coalesce(F.sum("mb"), F.lit(0)).alias("mass_before"), F.coalesce(F.sum("ma"), F.lit(0)).alias("mass_after"),
    )


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(vec_id, embedding): the k nearest rows by Euclidean distance of every query, itself excluded.

    Queries are taken in blocks of a fixed number of rows; each block is broadcast
    and multiplied with batches of vectors; a task returns k rows per query at most.
    """
    spark, parts, rows = vectors.sparkSession, [], []

    def scan(rows):
        ids = np.array([r[0] for r in rows])
        shared = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], np.float64)))

        def step(batches):
            ids, q = shared.value
            best: list[pd.DataFrame] = []
            for pdf in batches:
                v = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
                d = np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None])
                d[ids[:, None] == pdf.vec_id.to_numpy()[None]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                held = pd.DataFrame({"query_id": np.repeat(ids, near.shape[1]), "vec_id": pdf.vec_id.to_numpy()[near.ravel()], "d2": np.take_along_axis(d, near, 1).ravel()})
                best.append(held[np.isfinite(held.d2)])
                best = [pd.concat(best).sort_values(["query_id", "d2", "vec_id"]).groupby("query_id").head(k)]
            yield from best

        return vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInPandas(step, "query_id long, vec_id long, d2 double")

    for r in queries.select("vec_id", "embedding").where("embedding IS NOT NULL").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            parts.append(scan(rows))
            rows = []
    if rows or not parts:
        parts.append(scan(rows or [(-1, [0.0])]))
    w = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.sqrt("d2").alias("distance"))
