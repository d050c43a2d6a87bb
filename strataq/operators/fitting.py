"""Bounded nonlinear least squares and the residual bootstrap, many fits at a time.

A round is one aggregate over the rows for all fits that are still open: models and their
difference quotients are columns, so no fit's rows meet in one task.  The driver holds a few
numbers a fit, for at most ``MAX_FITS`` fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Store
from .calibration import uniform

#: Fits of one call; the driver solves one small system for each.
MAX_FITS = 10_000

Model = Callable[[Sequence[Column]], Column]


def _moments(rows: DataFrame, fit: str, model: Model, y: str, scale: Column, at: dict, upper: np.ndarray) -> dict:
    """Per fit: Gram matrix of the derivatives, their product with the residuals, residual sum, rows."""
    k = len(upper)
    table = []
    for name, theta in at.items():
        step = 1e-6 * np.maximum(1.0, np.abs(theta))
        table.append((name, *theta.tolist(), *np.where(theta + step > upper, -step, step).tolist()))
    shape = f"`{fit}` {rows.schema[fit].dataType.simpleString()}, " + ", ".join(f"_{n}{j} double" for n in "ph" for j in range(k))
    p, h = ([F.col(f"_{n}{j}") for j in range(k)] for n in "ph")
    level = model(p)
    slopes = [(model([*p[:j], p[j] + h[j], *p[j + 1 :]]) - level) / h[j] / scale for j in range(k)]
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, shape)), fit)  # MAX_FITS rows at most
    joined = joined.select(fit, ((F.col(y) - level) / scale).alias("_r"), *[s.alias(f"_d{j}") for j, s in enumerate(slopes)]).where("_r IS NOT NULL")
    d, pairs = [F.col(f"_d{j}") for j in range(k)], [(i, j) for i in range(k) for j in range(i, k)]
    sums = [d[i] * d[j] for i, j in pairs] + [c * F.col("_r") for c in d] + [F.col("_r") * F.col("_r")]
    out = {}
    for row in joined.groupBy(fit).agg(*[F.sum(s) for s in sums], F.count("*")).collect():
        gram = np.zeros((k, k))
        for (i, j), s in zip(pairs, row[1:]):
            gram[i, j] = gram[j, i] = s
        out[row[0]] = gram, np.array(row[1 + len(pairs) : 1 + len(pairs) + k], float), float(row[-2]), int(row[-1])
    return out


def _step(gram: np.ndarray, b: np.ndarray, damping: float, theta: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Damped step inside the box: what would leave it stops at its bound and the rest is solved again."""
    held = ((theta <= lower) & (b <= 0)) | ((theta >= upper) & (b >= 0))
    step = np.zeros(len(theta))
    damped = gram + damping * np.diag(np.maximum(np.diag(gram), 1e-300))
    while not held.all():
        free = ~held
        step[free] = np.linalg.lstsq(damped[np.ix_(free, free)], b[free] - damped[np.ix_(free, held)] @ step[held], rcond=None)[0]
        out = free & ((theta + step < lower) | (theta + step > upper))
        if not out.any():
            break
        step[out] = np.clip(theta + step, lower, upper)[out] - theta[out]
        held = held | out
    return step


def bounded_fits(rows: DataFrame, fit: str, model: Model, y: str, start: Sequence[float], lower: Sequence[float], upper: Sequence[float], sigma: str | None = None, rounds: int = 60) -> dict:
    """Levenberg-Marquardt fits inside a box, one for each value of ``fit``.

    ``model`` maps parameter columns to the predicted column; rows without prediction or
    observation, and rows whose ``fit`` is null, count in no fit.  ``theta_hat`` is None where
    a fit did not converge; ``terminal`` is then the last point.  More than ``MAX_FITS`` values
    of ``fit`` are refused.
    """
    theta0, lower, upper = (np.array(v, float) for v in (start, lower, upper))
    if (theta0 < lower).any() or (theta0 > upper).any():
        raise ValueError("the start must lie inside the bounds")
    names = [r[0] for r in rows.select(fit).where(F.col(fit).isNotNull()).distinct().limit(MAX_FITS + 1).collect()]
    if len(names) > MAX_FITS:
        raise ValueError(f"more than {MAX_FITS} fits")
    scale = F.col(sigma) if sigma else F.lit(1.0)
    state = _moments(rows, fit, model, y, scale, {n: theta0 for n in names}, upper) if names else {}
    theta, damping = {n: theta0 for n in state}, dict.fromkeys(state, 1e-3)
    done: dict = {}
    for used in range(1, rounds + 1):
        trial = {n: theta[n] + _step(*state[n][:2], damping[n], theta[n], lower, upper) for n in state if n not in done}
        if not trial:
            break
        got = _moments(rows, fit, model, y, scale, trial, upper)
        for n, new in trial.items():
            size = np.abs(new - theta[n]).max(initial=0.0) / max(1.0, np.abs(theta[n]).max(initial=0.0))
            better = n in got and got[n][3] >= state[n][3] and got[n][2] <= state[n][2]
            flat = better and state[n][2] - got[n][2] <= 1e-14 * state[n][2] and size <= 1e-5
            if better:
                theta[n], state[n], damping[n] = new, got[n], max(damping[n] / 10, 1e-12)
            else:
                damping[n] *= 10
            if size <= 1e-9 or flat:
                done[n] = used
            elif damping[n] > 1e12:
                done[n] = None
    out = {}
    for n, (_, _, rss, count) in state.items():
        converged, dof = done.get(n) is not None, count - len(theta0)
        out[n] = {"converged": converged, "theta_hat": theta[n].tolist() if converged else None, "terminal": theta[n].tolist(), "rss": rss, "n": count, "reduced_chi_square": rss / dof if dof > 0 else None, "at_bound": ((theta[n] <= lower) | (theta[n] >= upper)).tolist()}
    return out


def residual_bootstrap(rows: DataFrame, index: str, model: Model, y: str, theta: Sequence[float], lower: Sequence[float], upper: Sequence[float], sigma: str | None = None, draws: int = 200, confidence: float = 0.95, seed: str = "7") -> dict:
    """Percentile intervals of fitted parameters: residuals drawn anew, model refitted for every draw.

    ``index`` numbers the rows from 0 without gaps; draws are keyed by it.  The redrawn
    observations are a written table of draws x rows.  Draws whose refit does not converge are
    counted and left out.
    """
    store = Store(rows.sparkSession, "bootstrap")
    scale, level = F.col(sigma) if sigma else F.lit(1.0), model([F.lit(float(p)) for p in theta])
    base = store.put(rows.withColumns({"_level": level, "_z": (F.col(y) - level) / scale}))
    n = base.count()
    picks = base.drop("_z").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("_pick", F.floor(uniform(seed, F.col("_draw"), F.col(index)) * n))
    residuals = base.select(F.col(index).cast("long").alias("_pick"), "_z")
    redrawn = store.put(picks.join(residuals, "_pick").withColumn("_target", F.col("_level") + scale * F.col("_z")).drop("_pick", "_level", "_z"))
    fits = bounded_fits(redrawn, "_draw", model, "_target", theta, lower, upper, sigma)
    store.clear()
    kept = np.array([f["theta_hat"] for f in fits.values() if f["converged"]], float).reshape(-1, len(theta))
    if not len(kept):
        raise ValueError("no refit converged, so the intervals are not defined")
    tail = (1 - confidence) / 2
    return {"lower": np.quantile(kept, tail, axis=0), "upper": np.quantile(kept, 1 - tail, axis=0), "standard_error": kept.std(axis=0, ddof=1) if len(kept) > 1 else np.zeros(len(theta)), "bias": kept.mean(axis=0) - np.array(theta, float), "used": len(kept), "failed": draws - len(kept)}
