"""Constraints on states: projection, penalties, generated checks, freeze rule."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of a sweep.
SWEEP = ("bounds", "non_negativity", "symmetry", "conservation", "stoichiometry")


def violation(c: dict) -> Column:
    """Largest violation of one pointwise constraint beyond its tolerance."""
    tol, cols = c.get("tolerance", 0.0), [F.col(x) for x in c.get("columns", ())]
    at_least = lambda *xs: F.greatest(F.lit(0.0), *xs) if xs else F.lit(0.0)
    if c["kind"] == "bounds":
        low = [F.lit(c["lower"]) - x - tol for x in cols] if c.get("lower") is not None else []
        high = [x - F.lit(c["upper"]) - tol for x in cols] if c.get("upper") is not None else []
        return at_least(*low, *high)
    if c["kind"] == "non_negativity":
        return at_least(*[-x - tol for x in cols])
    if c["kind"] == "symmetry":
        return at_least(*[F.abs(F.col(a) - F.col(b)) - tol for a, b in c["pairs"]])
    if c["kind"] == "conservation":
        return at_least(F.abs(sum(cols[1:], cols[0]) - c["total"]) - tol)
    if c["kind"] == "stoichiometry":
        rows = [F.abs(sum((w * x for w, x in zip(row, cols)), F.lit(0.0)) - total) - tol for row, total in zip(c["matrix"], c["totals"])]
        return at_least(*rows)
    raise ValueError(f"not a pointwise constraint: {c['kind']}")


def penalty(constraints: Sequence[dict], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of squared violations of pointwise constraints, one value per row."""
    return sum(((weights or {}).get(c["id"], 1.0) * violation(c) ** 2 for c in constraints), F.lit(0.0))


def project(states: DataFrame, columns: Sequence[str], constraints: Sequence[dict], passes: int = 16, tolerance: float = 1e-12) -> DataFrame:
    """``states`` moved onto the constraints by alternating sweeps, with the size of the move and what is left.

    Bounds, then non-negativity, symmetry, conservation (in proportion where all are
    non-negative, else in equal shares), stoichiometry (least norm); until the largest
    violation is within tolerance or improves no more.
    """
    place = {c: i for i, c in enumerate(columns)}
    active = sorted(constraints, key=lambda c: SWEEP.index(c["kind"]))

    def worst(x, c):
        tol, at = c.get("tolerance", 0.0), [place[k] for k in c.get("columns", ())]
        if c["kind"] == "bounds":
            gap = np.maximum(-np.inf if c.get("lower") is None else c["lower"] - x[:, at], -np.inf if c.get("upper") is None else x[:, at] - c["upper"]).max(1)
        elif c["kind"] == "non_negativity":
            gap = (-x[:, at]).max(1)
        elif c["kind"] == "symmetry":
            gap = np.max([np.abs(x[:, place[a]] - x[:, place[b]]) for a, b in c["pairs"]], axis=0)
        elif c["kind"] == "conservation":
            gap = np.abs(x[:, at].sum(1) - c["total"])
        else:
            gap = np.abs(x[:, at] @ np.array(c["matrix"], float).T - np.array(c["totals"], float)).max(1)
        return np.maximum(0.0, gap - tol)

    def sweep(x, c):
        at = [place[k] for k in c.get("columns", ())]
        if c["kind"] == "bounds":
            x[:, at] = np.clip(x[:, at], c.get("lower"), c.get("upper")) if (c.get("lower") is not None or c.get("upper") is not None) else x[:, at]
        elif c["kind"] == "non_negativity":
            x[:, at] = np.maximum(x[:, at], 0.0)
        elif c["kind"] == "symmetry":
            for a, b in c["pairs"]:
                x[:, place[a]] = x[:, place[b]] = (x[:, place[a]] + x[:, place[b]]) / 2
        elif c["kind"] == "conservation":
            block, total = x[:, at], x[:, at].sum(1, keepdims=True)
            share = (block >= 0).all(1, keepdims=True) & (total > 0) & (c["total"] >= 0)
            x[:, at] = np.where(share, block * (c["total"] / np.where(total == 0, 1, total)), block + (c["total"] - total) / len(at))
        else:
            m = np.array(c["matrix"], float)
            x[:, at] += (np.array(c["totals"], float) - x[:, at] @ m.T) @ np.linalg.pinv(m @ m.T) @ m

    def step(batches):
        for pdf in batches:
            start = pdf[list(columns)].to_numpy(float)
            out, left = start.copy(), np.full(len(start), np.inf)
            going = np.ones(len(start), bool)
            before = np.max([worst(start, c) for c in active], axis=0) if active else np.zeros(len(start))
            for _ in range(passes if active else 0):
                if not going.any():
                    break
                x = out[going]
                for c in active:
                    sweep(x, c)
                out[going] = x
                rest = np.max([worst(x, c) for c in active], axis=0)
                old = np.where(np.isinf(left[going]), before[going], left[going])
                left[going] = rest
                going[going] = (rest > tolerance) & (old - rest > 1e-15 * np.maximum(1.0, old))
            pdf = pdf.copy()
            pdf[list(columns)] = out
            yield pdf.assign(moved=np.sqrt(((out - start) ** 2).sum(1)), left=np.where(np.isinf(left), before, left))

    schema = states.select("*", F.lit(0.0).alias("moved"), F.lit(0.0).alias("left")).schema
    return states.mapInPandas(step, schema)


def generated_checks(stocks: Sequence[tuple[str, bool]], closed_groups: Sequence[tuple[str, str, Sequence[str], float, float]], file: str = "trajectory.csv") -> list[dict]:
    """Checks of a trajectory: finite states, non-negative stocks, totals of closed groups by scenario.

    ``stocks`` (id, non_negative); ``closed_groups`` (id, scenario, stocks, initial total, tolerance).
    """
    base = {"csv_filename": file, "group_columns": ["scenario", "replicate"], "time_column": "time", "row_filters": [], "tolerance": 0.0}
    out = [base | {"id": "finite_states", "operation": "finite", "columns": [s for s, _ in stocks]}]
    if positive := [s for s, low in stocks if low]:
        out.append(base | {"id": "non_negative_stocks", "operation": "bounds", "columns": positive, "lower": 0.0})
    for ident, scenario, members, total, tolerance in closed_groups:
        out.append(base | {"id": f"conserved_{ident}_{scenario}"[:64], "operation": "sum_conservation", "columns": list(members), "reference_value": total, "tolerance": max(tolerance, 0.0), "row_filters": [{"column": "scenario", "equals": scenario}]})
    return out


def freeze_rule(checks: DataFrame) -> DataFrame:
    """(csv_filename, operation) to one row per file: has a finite check; and whether the whole may be frozen."""
    per = checks.groupBy("csv_filename").agg(F.bool_or(F.col("operation") == "finite").alias("has_finite"), F.count_if(F.col("operation") != "finite").alias("substantive"))
    every = per.agg((F.coalesce(F.bool_and("has_finite"), F.lit(False)) & (F.coalesce(F.sum("substantive"), F.lit(0)) > 0)).alias("may_freeze"))  # one row
    return per.crossJoin(every)


def conservation_report(df: DataFrame, groups: Sequence[str], members: Sequence[str], time: str) -> DataFrame:
    """Per group: first total, largest drift from it, least stock, and whether both hold."""
    total = sum((F.col(m) for m in members[1:]), F.col(members[0]))
    rows = df.select(*groups, time, total.alias("_total"), (F.least(*members) if len(members) > 1 else F.col(members[0])).alias("_least"))
    one = rows.groupBy(*groups).agg(F.min_by("_total", time).alias("initial"), F.min("_total").alias("_low"), F.max("_total").alias("_high"), F.min("_least").alias("least_stock"), F.count("*").alias("n"))
    drift = F.greatest(F.col("_high") - F.col("initial"), F.col("initial") - F.col("_low"))
    return one.select(*groups, "n", "initial", drift.alias("drift"), "least_stock", (F.col("least_stock") >= 0).alias("non_negative"), (drift <= 1e-9 * F.greatest(F.lit(1.0), F.abs("initial"))).alias("conserved"))

