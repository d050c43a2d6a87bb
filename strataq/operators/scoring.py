"""Scores of forecasts, calibration, ranks, tails and grouped reports.

All are aggregates with a map side; global ranks are taken from counts of distinct
values, so only the distinct values are ever sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import average_ranks, quantiles
from .ordered import tail_mean as cvar  # noqa: F401

CLIP = 1e-12


def log_loss(p: Column, y: Column, clip: float = CLIP) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def grouped_brier(df: DataFrame, group: str, p: str = "p", y: str = "y") -> DataFrame:
    """Brier score: mean over groups of the mean inside; log loss and counts over rows."""
    per = df.groupBy(group).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("b"), F.sum(log_loss(F.col(p), F.col(y))).alias("l"), F.count("*").alias("n"))
    return per.agg(F.avg("b").alias("brier"), (F.sum("l") / F.sum("n")).alias("log_loss"), F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def reliability(df: DataFrame, bins: int = 5, p: str = "p", y: str = "y") -> DataFrame:
    """One row per bin of width 1/bins, the last one closed; empty bins are kept."""
    per = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def murphy(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """ECE, MCE and Murphy's reliability - resolution + uncertainty."""
    b = reliability(df, bins, p, y).where("n > 0")
    total = b.agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")).alias("base"))  # one row
    gap, w = F.col("mean_p") - F.col("mean_y"), F.col("n") / F.col("all_n")
    return b.crossJoin(total).agg(
        F.sum(w * F.abs(gap)).alias("ece"), F.max(F.abs(gap)).alias("mce"), F.sum(w * gap * gap).alias("reliability"), F.sum(w * (F.col("mean_y") - F.col("base")) ** 2).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"), F.count("*").alias("occupied"),
    )


def crps(df: DataFrame, obs: str, x: str, y: str) -> DataFrame:
    """Ensemble CRPS per observation: mean |x - y| less the spread of the members."""
    w = Window.partitionBy(obs).orderBy(x)
    m = F.count("*").over(Window.partitionBy(obs))
    part = F.abs(F.col(x) - F.col(y)) / m - (2 * F.row_number().over(w) - m - 1) * F.col(x) / (m * m)
    return df.select(obs, part.alias("c")).groupBy(obs).agg(F.sum("c").alias("crps"))


def interval_score(low: Column, high: Column, y: Column, alpha: float) -> Column:
    """Winkler score: width plus 2/alpha for what lies outside."""
    return (high - low) + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0)))


def rank_auc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve by average ranks; null with one class only."""
    rows = df.groupBy(p).agg(F.sum(y).alias("pos"), F.count("*").alias("k")).join(average_ranks(df, p), p)
    n1, n = F.sum("pos"), F.sum("k")
    return rows.agg(((F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * (n - n1), F.lit(0))).alias("auc"), n1.cast("long").alias("positives"), n.alias("n_rows"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ra, rb = average_ranks(df, a).withColumnRenamed("rank", "ra"), average_ranks(df, b).withColumnRenamed("rank", "rb")
    return df.select(a, b).join(ra, a).join(rb, b).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n_rows"))


def gini(df: DataFrame, x: str) -> DataFrame:
    """Gini index of a non-negative column, from counts of distinct values."""
    r = df.groupBy(x).agg(F.count("*").alias("k")).join(average_ranks(df, x), x)
    n, s = F.sum("k"), F.sum(F.col("k") * F.col(x))
    return r.agg((2 * F.sum(F.col("rank") * F.col(x) * F.col("k")) / (n * s) - (n + 1) / n).alias("gini"), n.alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("k"))
    pairs = lambda c: (c * (c - 1) / 2).cast("double")
    one = lambda frame, name: frame.agg(F.sum(pairs(F.col("k"))).alias(name))
    side = lambda c: cells.groupBy(c).agg(F.sum("k").alias("k"))
    m = one(cells, "both").crossJoin(one(side(a), "sa")).crossJoin(one(side(b), "sb")).crossJoin(cells.agg(pairs(F.sum("k")).alias("all")))  # one row each
    expected = F.col("sa") * F.col("sb") / F.col("all")
    return m.select(((F.col("both") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))).alias("ari"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """Mutual information (nats) of two columns on an equal-width grid."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    cut = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * bins), F.lit(bins - 1))
    cells = df.crossJoin(ends).select(cut(x).alias("i"), cut(y).alias("j")).groupBy("i", "j").agg(F.count("*").alias("k"))  # at most bins * bins
    row, col, every = (F.sum("k").over(Window.partitionBy(*c)) for c in (["i"], ["j"], []))
    return cells.select("k", row.alias("a"), col.alias("b"), every.alias("n")).agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"), F.max("n").alias("n_pairs"))


def exact_match_f1(pairs: DataFrame, key: str, gold: str, answer: str) -> DataFrame:
    """Token F1 with multiset overlap, after lower case, no punctuation, no articles."""
    norm = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))
    rows = pairs.select(key, norm(gold).alias("g"), norm(answer).alias("a"))
    count = lambda c, n: rows.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    hits = count("g", "x").join(count("a", "y"), [key, "w"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("common"))
    c = F.coalesce("common", F.lit(0))
    return rows.join(hits, key, "left").select(key, (F.array_join("g", " ") == F.array_join("a", " ")).alias("exact"), F.coalesce(2 * c / F.nullif(F.size("g") + F.size("a"), F.lit(0)), F.lit(0.0)).alias("f1"))


def tail_report(df: DataFrame, group: str, x: str) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile, greatest value, and the 99th over the mean."""
    base = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.max(x).alias("worst"))
    out = base.join(quantiles(df, x, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, [group]), group)
    return out.withColumn("tail_ratio", F.col("p99") / F.nullif("mean", F.lit(0.0)))


def binned_residuals(df: DataFrame, x: str, residual: str, bins: int = 4, least: int = 3) -> DataFrame:
    """Mean and t of the residuals in bins between quantiles of ``x``; bins of fewer than ``least`` are dropped."""
    edges = quantiles(df, x, {f"e{i}": i / bins for i in range(1, bins)})  # one row
    bin_ = reduce(lambda a, i: a + F.when(F.col(x) >= F.col(f"e{i}"), 1).otherwise(0), range(1, bins), F.lit(0))
    v = F.col(residual)
    out = df.crossJoin(edges).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.avg(v) / F.nullif(F.stddev_samp(v) / F.sqrt(F.count("*")), F.lit(0.0))).alias("t_stat"))
    return out.where(F.col("n") >= least)


def failure_taxonomy(steps: DataFrame, classes: dict[str, str], trace: str, tool: str, cost: str, step: str) -> DataFrame:
    """Steps of each class (a step may be in several): incidents, traces, cost, dominant tool, first exemplar."""
    tags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in classes.items()]))
    i = steps.withColumn("failure", F.explode(tags))  # one scan
    main = i.groupBy("failure", tool).agg(F.count("*").alias("k")).groupBy("failure").agg(F.min_by(tool, F.struct(-F.col("k"), F.col(tool))).alias("dominant_tool"))
    traces = i.groupBy("failure", trace).agg(F.count("*").alias("k"), F.sum(cost).alias("c"), F.min(step).alias("s"))
    out = traces.groupBy("failure").agg(F.sum("k").alias("incidents"), F.count("*").alias("traces"), (F.round(F.sum("c"), 2) + 0.0).alias("cost"), F.min("s").alias("exemplar"))
    return out.join(main, "failure")


PRIOR_RATE, LEAST_COST, EXPLORE = 0.25, 0.1, 0.5


def voi_rank(open_items: DataFrame, history: DataFrame, costs: DataFrame, prior: float = PRIOR_RATE, explore: float = EXPLORE) -> DataFrame:
    """Rank of tools: sum of mass x resolution rate over kinds, by cost, times a bonus for little visited ones.

    ``open_items`` (tool, kind, mass), ``history`` (tool, kind, attempts, resolutions) and
    ``costs`` (tool, cost, visits).  A kind without attempts has the prior rate.
    """
    rate = F.when(F.coalesce("attempts", F.lit(0)) == 0, F.lit(prior)).otherwise(F.col("resolutions") / F.col("attempts"))
    gain = open_items.join(history, ["tool", "kind"], "left").groupBy("tool").agg(F.sum(F.col("mass") * rate).alias("gain"), F.count_if(F.coalesce("attempts", F.lit(0)) == 0).alias("priors"))
    most = costs.agg(F.max("visits").alias("most"))  # one row
    bonus = 1 + explore * (1 - F.coalesce(F.col("visits") / F.nullif("most", F.lit(0)), F.lit(0.0)))
    score = F.round(F.col("gain") / F.greatest("cost", F.lit(LEAST_COST)) * bonus, 4)
    out = gain.join(costs, "tool").crossJoin(most).select("tool", "priors", "gain", score.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tool")))  # one row per tool


def correlation_drift(df: DataFrame, proxy: str, t: str, v: str) -> DataFrame:
    """Correlation of every two proxies in the early and the late half of their history, and the change."""
    h = df.withColumn("_half", F.ntile(2).over(Window.partitionBy(proxy).orderBy(t)))
    a = h.select(t, "_half", F.col(proxy).alias("left_proxy"), F.col(v).alias("_x"))
    b = h.select(t, F.col(proxy).alias("right_proxy"), F.col(v).alias("_y"))
    half = lambda n: F.corr(F.when(F.col("_half") == n, F.col("_x")), F.when(F.col("_half") == n, F.col("_y")))
    r = a.join(b, t).where("left_proxy < right_proxy").groupBy("left_proxy", "right_proxy").agg(half(1).alias("early"), half(2).alias("late"))
    return r.withColumn("drift", F.col("late") - F.col("early"))
