"""Calibration of ensembles, predictive checks, resampling, recalibration, separability.

Draws are keyed hashes: the same seed and key give the same draw in any order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import lagged, quantiles, running, value_counts


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 48 bits of SHA-256 over the parts, joined by ``|``."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


# The coefficients of Acklam's rational approximation.
A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
LOW = 0.02425


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(u: Column) -> Column:
    """Quantile of the standard normal distribution."""
    u = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    tail = lambda v: polynomial(F.sqrt(-2 * F.log(v)), C) / polynomial(F.sqrt(-2 * F.log(v)), D)
    q = u - 0.5
    return F.when(u < LOW, tail(u)).when(u > 1 - LOW, -tail(1 - u)).otherwise(polynomial(q * q, A) * q / polynomial(q * q, B))


def service_time(law: str, mean: Column, dispersion: Column | float, u: Column) -> Column:
    """One service time from a uniform draw; every law keeps the mean."""
    u = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    d = F.lit(dispersion) if isinstance(dispersion, (int, float)) else dispersion
    if law == "deterministic":
        return mean
    if law == "exponential":
        return -mean * F.log(1 - u)
    if law == "lognormal":
        s = F.greatest(d, F.lit(1e-9))
        return mean * F.exp(s * inverse_normal(u) - 0.5 * s * s)
    if law == "pareto":
        return F.when(d > 1, mean * (d - 1) / d * F.pow(1 - u, -1 / d)).otherwise(F.raise_error(F.lit("a Pareto law needs a tail index above one")).cast("double"))
    raise ValueError(f"unknown service law {law}")


def pit(ensemble: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Share of members below each observation, ties half; one row per ``key``."""
    m = ensemble.groupBy(key).agg(F.count_if(F.col(x) < F.col(y)).alias("below"), F.count_if(F.col(x) == F.col(y)).alias("equal"), F.count("*").alias("members"))
    return m.select(key, "members", ((F.col("below") + 0.5 * F.col("equal")) / F.col("members")).alias("pit"))


def ks_uniform(df: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform distribution, and the count."""
    r = running(value_counts(df, value), value, "k")
    n = F.col("n")
    r = r.crossJoin(r.agg(F.sum("k").alias("n")))  # one row
    return r.agg(F.max(F.greatest((F.col("k_before") + F.col("k")) / n - F.col(value), F.col(value) - F.col("k_before") / n)).alias("ks"), F.first("n").alias("n"))


def pit_histogram(pits: DataFrame, bins: int = 10) -> DataFrame:
    per = pits.groupBy(F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = pits.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def interval_coverage(ensemble: DataFrame, key: str, x: str, y: str, levels: Sequence[float] = (0.5, 0.8, 0.9)) -> DataFrame:
    """Nominal level, share of observations inside the central interval, mean width.

    An ensemble is one observation's members, so exact percentiles are small groups.
    """
    cuts = [q for level in levels for q in ((1 - level) / 2, 1 - (1 - level) / 2)]
    per = ensemble.groupBy(key).agg(F.first(y).alias("y"), F.percentile(x, F.array(*map(F.lit, cuts))).alias("q"))
    rows = F.array(*[F.struct(F.lit(level).alias("nominal"), F.col("q")[2 * i].alias("lo"), F.col("q")[2 * i + 1].alias("hi")) for i, level in enumerate(levels)])
    flat = per.select("y", F.explode(rows).alias("r")).select("y", "r.*")
    return flat.groupBy("nominal").agg(F.avg(F.when(F.col("y").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)).alias("empirical"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"), F.count("*").alias("n"))


STATISTICS = ("mean", "variance", "standard_deviation", "max", "min", "range", "lag1_autocorrelation")


def statistics_of(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], x: str, bucket: float = 86400.0) -> DataFrame:
    """The summary statistics of each series, as long rows (keys, statistic, value)."""
    rows = lagged(df.select(*keys, time, *ties, x), keys, time, ties, {"_before": x}, bucket)
    v, b = F.col(x), F.col("_before")
    n, s, ss = F.count("*"), F.sum(v), F.sum(v * v)
    # sum (a - m)(b - m) over pairs, from sums that need no mean beforehand
    pairs, ab, a1, b1 = F.count(b), F.sum(v * b), F.sum(F.when(b.isNotNull(), v)), F.sum(b)
    m = s / n
    dev = ss - n * m * m
    acf = F.when(dev > 0, (ab - m * (a1 + b1) + pairs * m * m) / dev).otherwise(0.0)
    var = F.when(n > 1, F.greatest(F.lit(0.0), dev) / (n - 1)).otherwise(0.0)
    one = rows.groupBy(*keys).agg(m.alias("mean"), var.alias("variance"), F.sqrt(var).alias("standard_deviation"), F.max(v).alias("max"), F.min(v).alias("min"), (F.max(v) - F.min(v)).alias("range"), acf.alias("lag1_autocorrelation"))
    return one.unpivot(list(keys), list(STATISTICS), "statistic", "value")


def predictive_check(replicates: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of replicates whose statistic reaches the observed one, by ``keys`` and statistic."""
    o = observed.select(*keys, "statistic", F.col("value").alias("observed"))
    j = replicates.join(o, [*keys, "statistic"])
    p = F.avg(F.when(F.col("value") >= F.col("observed"), 1.0).otherwise(0.0))
    out = j.groupBy(*keys, "statistic").agg(F.first("observed").alias("observed"), F.avg("value").alias("replicate_mean"), p.alias("p_value"), F.count("*").alias("replicates"))
    return out.withColumn("direction", F.when(F.col("p_value") < 0.05, "observed_above_replicates").when(F.col("p_value") > 0.95, "observed_below_replicates").otherwise("not_flagged"))


RESAMPLES = 400


def _poisson_cuts(most: int = 8) -> list[float]:
    out, p, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def bootstrap(losses: DataFrame, unit: str, loss: str, groups: Sequence[str] = (), resamples: int = RESAMPLES, seed: str = "7") -> DataFrame:
    """Mean loss with the 10 and 90 % quantiles of its Poisson bootstrap over units.

    Every unit has a Poisson(1) weight per resample, from a keyed hash, so resamples are
    sums with a map side and no rows are drawn.
    """
    b = losses.select(*groups, unit, loss).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = uniform(F.lit(seed), F.col("_b"), F.col(unit))
    weight = reduce(lambda acc, c: acc + F.when(u >= c, 1).otherwise(0), _poisson_cuts(), F.lit(0))
    draws = b.withColumn("_w", weight).groupBy(*groups, "_b").agg((F.sum(F.col("_w") * F.col(loss)) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m")).where("_m IS NOT NULL")
    point = losses.groupBy(*groups).agg(F.avg(loss).alias("point"), F.count("*").alias("units"))
    span = draws.groupBy(*groups).agg(F.percentile("_m", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))  # RESAMPLES rows per group
    out = point.join(span, list(groups)) if groups else point.crossJoin(span)  # one row each
    return out.select(*groups, "point", "units", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def platt(df: DataFrame, x: str, y: str, iterations: int = 25) -> tuple[float, float]:
    """Intercept and slope of a logistic recalibration; each step is one aggregate of a 2 x 2 system."""
    beta = np.zeros(2)
    for _ in range(iterations):
        p = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col(x))))
        w = F.greatest(p * (1 - p), F.lit(1e-6))
        g0, g1, h00, h01, h11 = df.agg(F.sum(F.col(y) - p), F.sum((F.col(y) - p) * F.col(x)), F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) * F.col(x))).first()
        step = np.linalg.solve(np.array([[h00 + 1e-6, h01], [h01, h11 + 1e-6]]), np.array([g0, g1]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def recalibrate(df: DataFrame, x: str, beta: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(beta[0]) + F.lit(beta[1]) * F.col(x))))


def shrink_to_base(train: DataFrame, p: str, y: str) -> DataFrame:
    """One row (base, alpha): the share alpha by which forecasts move to the base rate, clipped to [0, 1].

    It is the least-squares weight of the base rate against the forecast, from moments of one pass.
    Without rows, or where every forecast is the base rate, alpha is null.
    """
    q, v = F.col(p), F.col(y)
    m = train.agg(F.avg(v).alias("base"), F.avg(q).alias("_p"), F.avg(v * q).alias("_yp"), F.avg(q * q).alias("_pp"))
    b = F.col("base")
    share = (b * b - b * F.col("_p") - F.col("_yp") + F.col("_pp")) / F.nullif(b * b - 2 * b * F.col("_p") + F.col("_pp"), F.lit(0.0))
    return m.select("base", F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).alias("alpha"))


def separability(df: DataFrame, model: str, x: str, unit: str) -> DataFrame:
    """Every two models: AUC of ``x``, standardized difference, two-fold Gaussian accuracy.

    Folds are the parity of a hash of ``unit``; a fold is classified by means and variances
    of the other, equal priors.
    """
    fold = F.when(uniform("fold", F.col(unit)) < 0.5, 0).otherwise(1)
    v = F.col(x)
    rows = df.select(model, x, fold.alias("fold"))
    m = rows.groupBy(model).agg(F.avg(v).alias("m"), F.var_samp(v).alias("s2"), F.count("*").alias("n"))
    names = df.select(model).distinct()
    pairs = names.select(F.col(model).alias("left")).join(names.select(F.col(model).alias("right")), F.col("left") < F.col("right"))  # of models, not of rows
    counts = rows.groupBy(model, x).agg(F.count("*").alias("k"))
    both = pairs.join(counts, (F.col(model) == F.col("left")) | (F.col(model) == F.col("right")))
    per = both.groupBy("left", "right", x).agg(F.sum(F.when(F.col(model) == F.col("right"), F.col("k")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(model) == F.col("left"), F.col("k")).otherwise(0)).alias("neg"))
    r = running(per, x, "neg", groups=["left", "right"])
    auc = r.groupBy("left", "right").agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    one = lambda side: m.select(F.col(model).alias(side), *[F.col(c).alias(f"{side[0]}_{c}") for c in ("m", "s2", "n")])
    out = pairs.join(one("left"), "left").join(one("right"), "right").join(auc, ["left", "right"])
    gap = (F.col("r_m") - F.col("l_m")) / F.nullif(F.sqrt((F.col("l_s2") + F.col("r_s2")) / 2), F.lit(0.0))
    fitted = rows.groupBy(model, "fold").agg(F.avg(v).alias("m"), F.greatest(F.var_pop(v), F.lit(1e-12)).alias("s2"))
    other = lambda side: fitted.select(F.col(model).alias(side), (1 - F.col("fold")).alias("fold"), F.col("m").alias(f"{side[0]}m"), F.col("s2").alias(f"{side[0]}s"))
    tests = pairs.join(rows, (F.col(model) == F.col("left")) | (F.col(model) == F.col("right"))).join(F.broadcast(other("left")), ["left", "fold"]).join(F.broadcast(other("right")), ["right", "fold"])  # two rows per model
    like = lambda a, b: -0.5 * (F.log(F.col(b)) + (v - F.col(a)) ** 2 / F.col(b))
    right = F.when(F.col(model) == F.col("left"), like("lm", "ls") >= like("rm", "rs")).otherwise(like("rm", "rs") > like("lm", "ls"))
    accuracy = tests.groupBy("left", "right").agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"))
    return out.join(accuracy, ["left", "right"]).select("left", "right", "auc", gap.alias("difference"), "accuracy")


def cost_ratio(df: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """Mean and median of actual over predicted cost, where the prediction is positive."""
    rows = df.where(F.col(predicted) > 0).select(group, (F.col(actual) / F.col(predicted)).alias("ratio"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio")).join(quantiles(rows, "ratio", {"median_ratio": 0.5}, [group]), group)
