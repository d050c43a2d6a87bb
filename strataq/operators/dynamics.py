"""Dynamics over rows of parameters or states: Jacobians, equilibria, scans, exponents, embeddings.

Every row, or every series, is its own small problem; tasks hold one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Flow = Callable[[np.ndarray, dict], np.ndarray]
STILL = 1e-7  # real parts below this are marginal


def jacobian(flow: Flow, x: np.ndarray, row: dict, h: float = 1e-5) -> np.ndarray:
    """Central differences, steps in proportion to the state."""
    out = np.empty((len(x), len(x)))
    for j in range(len(x)):
        step = h * max(1.0, abs(x[j]))
        up, down = x.copy(), x.copy()
        up[j] += step
        down[j] -= step
        out[:, j] = (flow(up, row) - flow(down, row)) / (2 * step)
    return out


def spectrum_class(values: np.ndarray) -> tuple[str, bool]:
    """Kind of a fixed point by its eigenvalues, and whether it is stable."""
    real = values.real
    if (np.abs(real) <= STILL).any():
        return "marginal", False
    if (real > 0).any() and (real < 0).any():
        return "saddle", False
    return ("focus" if (np.abs(values.imag) > STILL).any() else "node"), bool((real < 0).all())


def stability(rows: DataFrame, key: str, states: Sequence[str], flow: Flow) -> DataFrame:
    """(key, kind, stable, leading): the linearised flow at the state of each row."""

    def step(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                values = np.linalg.eigvals(jacobian(flow, np.array([row[s] for s in states], float), row))
                out.append((row[key], *spectrum_class(values), float(values.real.max())))
            yield pd.DataFrame(out, columns=[key, "kind", "stable", "leading"])

    return rows.mapInPandas(step, f"{key} {rows.schema[key].dataType.simpleString()}, kind string, stable boolean, leading double")


def newton(flow: Flow, x: np.ndarray, row: dict, rounds: int = 60, tolerance: float = 1e-11) -> np.ndarray | None:
    """A root by damped Newton steps; none where it does not settle."""
    for _ in range(rounds):
        f = flow(x, row)
        size = np.abs(f).max()
        if size < tolerance:
            return x
        try:
            move = np.linalg.solve(jacobian(flow, x, row), -f)
        except np.linalg.LinAlgError:
            return None
        scale = 1.0
        while scale > 1e-4 and not np.abs(flow(x + scale * move, row)).max() < size:
            scale /= 2
        x = x + scale * move
        if not np.isfinite(x).all():
            return None
    return x if np.abs(flow(x, row)).max() < 1e-8 else None


def equilibria(rows: DataFrame, key: str, starts: Sequence[Sequence[float]], flow: Flow, apart: float = 1e-5) -> DataFrame:
    """(key, branch, state, kind, stable): roots reached from any start, each once, in order.

    Over a grid of parameters this is a scan: one small problem per value, branches are
    numbered by the order of their states.
    """

    def step(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                roots: list[np.ndarray] = []
                for s in starts:
                    x = newton(flow, np.array(s, float), row)
                    if x is not None and all(np.abs(x - r).max() > apart for r in roots):
                        roots.append(x)
                for i, x in enumerate(sorted(roots, key=lambda r: tuple(np.round(r, 6)))):
                    out.append((row[key], i, x.tolist(), *spectrum_class(np.linalg.eigvals(jacobian(flow, x, row)))))
            yield pd.DataFrame(out, columns=[key, "branch", "state", "kind", "stable"])

    return rows.mapInPandas(step, f"{key} {rows.schema[key].dataType.simpleString()}, branch int, state array<double>, kind string, stable boolean")


def embed(x: np.ndarray, lag: int, dimension: int) -> np.ndarray:
    n = len(x) - (dimension - 1) * lag
    return np.stack([x[k * lag : k * lag + n] for k in range(dimension)], 1) if n > 0 else np.zeros((0, dimension))


def first_lag(x: np.ndarray, most: int, bins: int = 16) -> int:
    """First local minimum of mutual information, or where it falls below 1/e of its start, whichever is earlier."""
    info = []
    for lag in range(most + 1):
        joint, _, _ = np.histogram2d(x[: len(x) - lag], x[lag:], bins)
        p = joint / joint.sum()
        a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
        hit = p > 0
        info.append(float((p[hit] * np.log(p[hit] / (a @ b)[hit])).sum()))
        if lag and info[-1] < info[0] / np.e:
            return lag
        if lag > 1 and info[-2] < info[-3] and info[-2] <= info[-1]:
            return lag - 1
    return most


def nearest(points: np.ndarray, apart: int = 0, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest other point, more than ``apart`` steps away in time."""
    n, index, far = len(points), np.zeros(len(points), int), np.zeros(len(points))
    for at in range(0, n, block):
        d = np.sqrt(((points[at : at + block, None] - points[None]) ** 2).sum(-1))
        close = np.abs(np.arange(at, min(at + block, n))[:, None] - np.arange(n)[None]) <= apart
        d[close] = np.inf
        index[at : at + block], far[at : at + block] = d.argmin(1), d.min(1)
    return index, far


def attractor(series: DataFrame, key: str, order: str, value: str, most_lag: int = 20, most_dimension: int = 6) -> DataFrame:
    """(key, n, lag, dimension, false_share): embedding lag, and the first dimension with few false neighbours."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        lag, dimension, share = 1, 1, None
        if len(x) >= 50 and x.std() > 0:
            lag = first_lag(x, min(most_lag, len(x) // 10))
            for dimension in range(1, most_dimension + 1):
                wide = embed(x, lag, dimension + 1)
                index, far = nearest(wide[:, :dimension], lag)
                extra = np.abs(wide[:, -1] - wide[index, -1])
                share = float(np.mean((extra > 10 * np.maximum(far, 1e-12)) | (extra > 2 * x.std())))
                if share < 0.05:
                    break
        return pd.DataFrame({"series": [str(pdf[key].iloc[0])], "n": [len(x)], "lag": [lag], "dimension": [dimension], "false_share": [share]})

    return series.select(key, order, value).groupBy(key).applyInPandas(fit, "series string, n long, lag int, dimension int, false_share double")


def rosenstein(x: np.ndarray, lag: int = 1, dimension: int = 3, apart: int = 10, horizon: int = 12) -> float | None:
    """Slope of the mean logarithmic divergence of nearest neighbours."""
    points = embed(np.asarray(x, float), lag, dimension)
    if len(points) < apart + horizon + 10:
        return None
    index, _ = nearest(points[:-horizon], apart)
    curve = []
    for k in range(horizon):
        gap = np.sqrt(((points[k : len(points) - horizon + k] - points[index + k]) ** 2).sum(1))
        curve.append(np.log(gap[gap > 0]).mean() if (gap > 0).any() else np.nan)
    ok = np.isfinite(curve)
    return float(np.polyfit(np.arange(horizon)[ok], np.array(curve)[ok], 1)[0]) if ok.sum() > 2 else None


def lyapunov(series: DataFrame, key: str, order: str, value: str, **options) -> DataFrame:
    """Largest Lyapunov exponent per step, from each series."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame({"series": [str(pdf[key].iloc[0])], "n": [len(x)], "exponent": [rosenstein(x, **options)]})

    return series.select(key, order, value).groupBy(key).applyInPandas(fit, "series string, n long, exponent double")
