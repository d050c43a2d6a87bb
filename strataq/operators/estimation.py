"""Estimation: normal equations, fits, designs, sensitivity, sparse regression, queueing formulas.

Sums over rows are aggregates with a map side; what is solved is a matrix of a few columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import uniform


def moments(df: DataFrame, xs: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Gram matrix of (1, xs), its product with y, sum of y squared, and rows: one aggregate."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k, v = len(cols), F.col(y).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(cols[i] * cols[j]) for i, j in pairs], *[F.sum(c * v) for c in cols], F.sum(v * v), F.count("*")).first()
    gram = np.zeros((k, k))
    for (i, j), s in zip(pairs, row):
        gram[i, j] = gram[j, i] = s or 0.0
    return gram, np.array([s or 0.0 for s in row[len(pairs) : len(pairs) + k]]), float(row[-2] or 0.0), int(row[-1])


def least_squares(df: DataFrame, xs: Sequence[str], y: str) -> dict:
    """Coefficients (constant first), standard errors, correlation of estimates, R2, condition number."""
    gram, b, yy, n = moments(df, xs, y)
    beta = np.linalg.lstsq(gram, b, rcond=None)[0]
    rss = max(0.0, yy - float(beta @ b))
    tss = yy - float(b[0]) ** 2 / n if n else 0.0
    values, vectors = np.linalg.eigh(gram)
    floor = max(values.max(), 0.0) * 1e-12
    cov = (vectors / np.maximum(values, floor or 1e-300)) @ vectors.T * (rss / max(1, n - len(beta)))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    corr = cov / np.where(np.outer(se, se) > 0, np.outer(se, se), 1)
    return {"n": n, "names": ["one", *xs], "beta": beta, "standard_error": se, "correlation": corr, "rss": rss, "r2": 1 - rss / tss if tss > 0 else None, "condition": float(values.max() / max(values.min(), floor or 1e-300)), "weak": vectors[:, 0]}


#: Correlation of two estimates that cannot be told apart, and that is suspicious; weakest direction.
COLLINEAR, SUSPICIOUS, WEAK = 0.95, 0.9, 1e-8


def identifiability(fit: dict) -> dict:
    """Which estimates the data tell apart: collinear pairs, and the loading of a null direction."""
    names, corr = fit["names"], np.abs(fit["correlation"])
    pairs = [(names[i], names[j], float(corr[i, j])) for i in range(len(names)) for j in range(i) if corr[i, j] > SUSPICIOUS]
    null = 1 / fit["condition"] < WEAK
    loaded = [n for n, w in zip(names, np.abs(fit["weak"])) if w > 0.1] if null else []
    verdict = "not_identifiable" if null or any(r > COLLINEAR for *_, r in pairs) else "weakly_identifiable" if pairs else "identifiable"
    return {"verdict": verdict, "pairs": pairs, "null_direction": loaded}


def linear_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def best_family(df: DataFrame, group: str, x: str, y: str, top: float | None = None) -> DataFrame:
    """Residual sums of a line, an exponential and, below ``top``, a logistic curve; the least wins, the first of equals.

    The last two are lines in ln y and in the logit of y / top, judged on y itself.
    """
    v = F.col(y)
    forms = {"linear": (v, lambda f: f), "exponential": (F.when(v > 0, F.log(v)), F.exp)}
    if top is not None:
        forms["logistic"] = (F.when((v > 0) & (v < top), F.log(v / (top - v))), lambda f: top / (1 + F.exp(-f)))
    rows = df.select(group, x, y, *[c.alias(f"_{k}") for k, (c, _) in forms.items()])
    fits = rows.groupBy(group).agg(*[f(f"_{k}", x).alias(f"_{n}_{k}") for k in forms for n, f in (("a", F.regr_intercept), ("b", F.regr_slope))])
    errors = [F.sum((v - back(F.col(f"_a_{k}") + F.col(f"_b_{k}") * F.col(x))) ** 2).alias(k) for k, (_, back) in forms.items()]
    out = rows.join(fits, group).groupBy(group).agg(F.count("*").alias("n"), *errors)
    ranked = F.sort_array(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("rss"), F.lit(i).alias("i"), F.lit(k).alias("family"))) for i, k in enumerate(forms)])))
    return out.select(group, "n", ranked[0]["family"].alias("family"), ranked[0]["rss"].alias("rss"))


def power_terms(columns: dict[str, Column], degree: int = 2, trig: bool = False) -> dict[str, Column]:
    """Named terms of a polynomial library: 1, products up to a degree, and sines and cosines."""
    out = {"one": F.lit(1.0)}
    for d in range(1, degree + 1):
        for names in combinations_with_replacement(columns, d):
            term = F.lit(1.0)
            for n in names:
                term = term * columns[n]
            out["*".join(names)] = term
    if trig:
        out |= {f"{f.__name__}({n})": f(c) for n, c in columns.items() for f in (F.sin, F.cos)}
    return out


def stlsq(df: DataFrame, xs: Sequence[str], y: str, threshold: float = 0.1, rounds: int = 10) -> dict:
    """Sparse regression by repeated thresholding: terms below ``threshold`` go, the rest is fitted again.

    All rounds solve parts of one Gram matrix, so the data are read once.
    """
    gram, b, yy, n = moments(df, xs, y)
    gram, b, keep = gram[1:, 1:], b[1:], np.ones(len(xs), bool)
    beta = np.linalg.lstsq(gram, b, rcond=None)[0]
    for _ in range(rounds):
        new = np.abs(beta) >= threshold
        if (new == keep).all():
            break
        keep, beta = new, np.zeros(len(xs))
        if keep.any():
            beta[keep] = np.linalg.lstsq(gram[np.ix_(keep, keep)], b[keep], rcond=None)[0]
    rss = max(0.0, yy - 2 * float(beta @ b) + float(beta @ gram @ beta))
    equation = " + ".join(f"{c:.6g}*{x}" for c, x in zip(beta, xs) if c) or "0"
    return {"n": n, "beta": beta, "terms": [x for x, c in zip(xs, beta) if c], "rmse": math.sqrt(rss / n) if n else None, "equation": f"{y} = {equation}"}


def morris_design(spark, factors: int, trajectories: int, levels: int = 4, seed: str = "11") -> DataFrame:
    """(trajectory, step, changed, x0 ...): one-at-a-time paths on a grid, from keyed draws.

    Step k differs from step k - 1 in one factor, in a keyed order, by levels / 2 grid steps.
    """
    half, jump = levels // 2, levels / 2 / (levels - 1)
    base = spark.range(trajectories).select(F.col("id").alias("trajectory"), *[F.floor(uniform(seed, F.col("id"), f"x{j}") * half).cast("double").alias(f"s{j}") for j in range(factors)], F.transform(F.sort_array(F.array(*[F.struct(uniform(seed, F.col("id"), f"o{j}").alias("u"), F.lit(j).alias("j")) for j in range(factors)])), lambda s: s["j"]).alias("order"))
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(factors))))
    moved = lambda j: F.array_position("order", F.lit(j)) <= F.col("step")
    return steps.select("trajectory", "step", F.when(F.col("step") > 0, F.element_at("order", F.greatest(F.col("step"), F.lit(1)))).alias("changed"), *[(F.col(f"s{j}") / (levels - 1) + F.when(moved(j), jump).otherwise(0.0)).alias(f"x{j}") for j in range(factors)])


def morris_effects(runs: DataFrame, levels: int = 4) -> DataFrame:
    """mu, mu*, sigma of each factor from evaluated designs (trajectory, step, changed, y)."""
    from pyspark.sql import Window

    jump = levels / 2 / (levels - 1)
    e = runs.select("changed", ((F.col("y") - F.lag("y").over(Window.partitionBy("trajectory").orderBy("step"))) / jump).alias("e")).where("changed IS NOT NULL")
    return e.groupBy(F.col("changed").alias("factor")).agg(F.avg("e").alias("mu"), F.avg(F.abs("e")).alias("mu_star"), F.stddev_samp("e").alias("sigma"))


def sobol_design(spark, factors: int, n: int, seed: str = "13") -> DataFrame:
    """(i, matrix, x0 ...): matrices A, B and A with column j of B, by keyed uniform draws."""
    r = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(-2), F.lit(-1), *[F.lit(j) for j in range(factors)])).alias("matrix"))
    draw = lambda side, j: uniform(seed, F.col("i"), f"{side}{j}")
    return r.select("i", "matrix", *[F.when((F.col("matrix") == -1) | (F.col("matrix") == j), draw("b", j)).otherwise(draw("a", j)).alias(f"x{j}") for j in range(factors)])


def sobol_indices(runs: DataFrame) -> DataFrame:
    """First-order and total index of each factor from evaluated matrices (i, matrix, y)."""
    a, b = runs.where("matrix = -2").select("i", F.col("y").alias("a")), runs.where("matrix = -1").select("i", F.col("y").alias("b"))
    j = runs.where("matrix >= 0").select("i", F.col("matrix").alias("factor"), F.col("y").alias("ab")).join(a.join(b, "i"), "i")
    var = a.unionByName(b.withColumnRenamed("b", "a")).agg(F.var_pop("a").alias("v"))  # one row
    out = j.groupBy("factor").agg(F.avg(F.col("b") * (F.col("ab") - F.col("a"))).alias("s"), (F.avg((F.col("a") - F.col("ab")) ** 2) / 2).alias("t"))
    return out.crossJoin(var).select("factor", (F.col("s") / F.nullif("v", F.lit(0.0))).alias("first_order"), (F.col("t") / F.nullif("v", F.lit(0.0))).alias("total"))


def ishigami(x0: Column, x1: Column, x2: Column) -> Column:
    """The test function of sensitivity analysis, for inputs in [0, 1)."""
    p = [2 * math.pi * x - math.pi for x in (x0, x1, x2)]
    return F.sin(p[0]) + 7 * F.sin(p[1]) ** 2 + 0.1 * F.pow(p[2], F.lit(4.0)) * F.sin(p[0])


def support(df: DataFrame, training: DataFrame, columns: Sequence[str], margin: float = 0.05) -> DataFrame:
    """``df`` with ``support``: interior, boundary or extrapolation against the box of the training rows."""
    box = training.agg(*[f(c).alias(f"_{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    out, edge = F.lit(False), F.lit(False)
    for i, c in enumerate(columns):
        lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        out = out | (F.col(c) < lo) | (F.col(c) > hi)
        edge = edge | (F.col(c) < lo + margin * (hi - lo)) | (F.col(c) > hi - margin * (hi - lo))
    return df.crossJoin(box).select(*df.columns, F.when(out, "extrapolation").when(edge, "boundary").otherwise("interior").alias("support"))


def error_parts(df: DataFrame, group: str, x: str, predicted: str, replicate: str) -> DataFrame:
    """Mean squared error of a prediction as noise (within replicates) and discrepancy (their means against it)."""
    per = df.groupBy(group, replicate).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"), F.avg(predicted).alias("f"), F.sum((F.col(x) - F.col(predicted)) ** 2).alias("e"))
    noise = F.sum(F.col("v") * (F.col("n") - 1)) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))
    gap = F.sum(F.col("n") * (F.col("m") - F.col("f")) ** 2) / F.sum("n")
    return per.groupBy(group).agg((F.sum("e") / F.sum("n")).alias("total"), noise.alias("noise"), gap.alias("mean_gap"), F.greatest(F.lit(0.0), gap - noise * F.count("*") / F.sum("n")).alias("discrepancy"))


def erlang_b(load: Column, servers: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), servers), F.lit(1.0), lambda x, i: load * x / (i + load * x))


def erlang_c(load: Column, servers: Column) -> Column:
    b = erlang_b(load, servers)
    return b / (1 - load / servers * (1 - b))


def mmc(rate: Column, service: Column, servers: Column) -> dict[str, Column]:
    """Wait, queue and use of a station with Poisson arrivals; null where it is not stable."""
    load = rate / service
    stable = load < servers
    wait = F.when(stable, erlang_c(load, servers) / (servers * service - rate))
    return {"utilisation": load / servers, "mean_wait": wait, "mean_queue": rate * wait, "mean_time": wait + 1 / service}


def mmck(rate: Column, service: Column, servers: int, capacity: int) -> dict[str, Column]:
    """Share turned away and mean number of a station that holds ``capacity`` at most."""
    load = rate / service
    terms, t = [], F.lit(1.0)
    for n in range(capacity + 1):
        terms.append(t)
        t = t * load / min(n + 1, servers)
    total = sum(terms[1:], terms[0])
    mean = sum((n * x for n, x in enumerate(terms)), F.lit(0.0)) / total
    blocked = terms[-1] / total
    return {"blocked": blocked, "mean_number": mean, "throughput": rate * (1 - blocked), "mean_time": mean / (rate * (1 - blocked))}
