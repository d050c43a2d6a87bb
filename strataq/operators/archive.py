"""Quality-diversity archives: scalarised scores, cells, admission outcomes, parents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibration import uniform

#: name, lower, upper, direction, weight
Objective = tuple[str, float, float, str, float]


def scalarize(objectives: Sequence[Objective]) -> tuple[Column, Column]:
    """Weighted mean of objectives mapped to [0, 1], higher is better; and how many were clipped."""
    total, weights, clipped = F.lit(0.0), 0.0, F.lit(0)
    for name, low, high, direction, weight in objectives:
        inside = F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))
        unit = (inside - low) / (high - low)
        total = total + weight * (1 - unit if direction == "minimize" else unit)
        clipped = clipped + (inside != F.col(name)).cast("int")
        weights += weight
    return total / weights, clipped


def admit(candidates: DataFrame, objectives: Sequence[Objective], capacity: int = 8) -> DataFrame:
    """Outcome of every candidate, in order of ``added`` inside its cell.

    ``candidates`` (id, cell, added, feasible, objectives): infeasible, new_cell,
    dominated_rejected, dominates_existing or nondominated_added; and ``kept``, whether the
    cell's front still holds it at the end.  A front beyond ``capacity`` loses the member of
    least crowding distance (then least score, then least id).  Outcomes depend on the order, so a cell is one
    fold; a cell holds its front only while it folds.
    """
    names = [o[0] for o in objectives]
    sign = np.array([-1.0 if o[3] == "minimize" else 1.0 for o in objectives])
    span = np.array([o[2] - o[1] for o in objectives])
    low, weight = np.array([o[1] for o in objectives]), np.array([o[4] for o in objectives])

    def score(v):
        unit = np.clip((v - low) / span, 0, 1)
        return float((weight * np.where(sign < 0, 1 - unit, unit)).sum() / weight.sum())

    def crowding(front):
        out = np.zeros(len(front))
        for k in range(len(names)):
            order = sorted(range(len(front)), key=lambda i: (front[i][1][k], front[i][0]))
            width = front[order[-1]][1][k] - front[order[0]][1][k]
            out[[order[0], order[-1]]] = np.inf
            for a, b, c in zip(order, order[1:], order[2:]):
                out[b] += (front[c][1][k] - front[a][1][k]) / width if width > 0 else 0.0
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["added", "id"], kind="stable")
        front: list[tuple[int, np.ndarray, float]] = []
        outcomes, seen = [], False
        for ident, ok, *values in pdf[["id", "feasible", *names]].itertuples(index=False):
            v = np.array(values, float)
            if not ok:
                outcomes.append("infeasible")
                continue
            gaps = [sign * (m[1] - v) for m in front]
            if any((g >= 0).all() and (g > 0).any() for g in gaps):
                outcomes.append("dominated_rejected")
                continue
            beaten = [(g <= 0).all() and (g < 0).any() for g in gaps]
            outcomes.append("new_cell" if not seen else "dominates_existing" if any(beaten) else "nondominated_added")
            seen = True
            front = [m for m, lost in zip(front, beaten) if not lost] + [(ident, v, score(v))]
            while len(front) > capacity:
                far = crowding(front)
                front.pop(min(range(len(front)), key=lambda i: (far[i], front[i][2], front[i][0])))
        kept = {m[0] for m in front}
        return pd.DataFrame({"id": pdf.id, "cell": pdf.cell, "outcome": outcomes, "kept": [i in kept for i in pdf.id]})

    rows = candidates.select("id", "cell", "added", "feasible", *[F.col(n).cast("double").alias(n) for n in names])
    return rows.groupBy("cell").applyInPandas(fold, f"id {candidates.schema['id'].dataType.simpleString()}, cell {candidates.schema['cell'].dataType.simpleString()}, outcome string, kept boolean")


def select_parents(front: DataFrame, n: int, strategy: str = "least_visited", seed: str = "5") -> DataFrame:
    """``n`` members (id, cell, score, visits) by a stated strategy: least_visited, best_score or uniform (seeded)."""
    order = {"least_visited": ["visits", F.desc("score"), "id"], "best_score": [F.desc("score"), "id"], "uniform": [uniform(seed, F.col("id")), "id"]}[strategy]
    return front.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def snapshot(df: DataFrame) -> DataFrame:
    """One row per cell: its members and their number, as an archive is stored; members are sorted."""
    return df.groupBy("cell").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "score"))).alias("members"))


def restore(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("cell", F.explode("members").alias("m")).select("cell", "m.id", "m.score")
