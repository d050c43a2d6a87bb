"""Simulations by keyed draws: arrivals, stations, stocks and flows, influence, cascades.

A draw depends on its key alone, so scenarios share their noise and any task can make it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Store
from .calibration import uniform


def poisson_arrivals(streams: DataFrame, key: str, rate: str, n: int, seed: str = "17") -> DataFrame:
    """(key, i, at): ``n`` arrivals of each stream, gaps exponential by keyed draws."""
    gaps = streams.select(key, rate, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    gaps = gaps.withColumn("gap", -F.log(1 - F.least(uniform(seed, F.col(key), F.col("i")), F.lit(1 - 1e-12))) / F.col(rate))
    return gaps.select(key, "i", F.sum("gap").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("at"))


def single_server(requests: DataFrame, key: str, order: str, at: str, service: str) -> DataFrame:
    """First-come first-served waiting times of one server per key.

    Lindley's recursion in closed form: with U the sum of (service - gap) so far, the wait is
    U less the least U so far, both window sums.
    """
    w = Window.partitionBy(key).orderBy(order)
    gap = F.col(at) - F.lag(at).over(w)
    step = F.coalesce(F.lag(service).over(w) - gap, F.lit(0.0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = requests.withColumn("_step", step).withColumn("_u", F.sum("_step").over(upto))
    return rows.withColumn("wait", F.col("_u") - F.min("_u").over(upto)).drop("_step", "_u")


def station_rollup(served: DataFrame, key: str, at: str, service: str, slo: float) -> DataFrame:
    """Per station: requests, share within ``slo``, throughput, and both sides of Little's law."""
    done = F.col(at) + F.col("wait") + F.col(service)
    per = served.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col("wait") + F.col(service) <= slo, 1.0).otherwise(0.0)).alias("slo_met"), F.max(done).alias("end"), F.min(at).alias("start"), F.sum(F.col("wait") + F.col(service)).alias("sojourn"), F.sum(service).alias("busy"))
    span = F.col("end") - F.col("start")
    return per.select(key, "n", "slo_met", (F.col("n") / span).alias("throughput"), (F.col("busy") / span).alias("utilisation"), (F.col("sojourn") / span).alias("mean_number"), (F.col("n") / span * F.col("sojourn") / F.col("n")).alias("little"))


def trace_summary(trace: DataFrame, key: str, kind: str, size: str, burst: Column) -> DataFrame:
    """Requests by class, share in bursts, tail ratio (greatest over mean) of each trace."""
    per = trace.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("classes"), F.avg(F.when(burst, 1.0).otherwise(0.0)).alias("burst_fraction"), (F.max(size) / F.nullif(F.avg(size), F.lit(0.0))).alias("tail_ratio"))
    return per


def integrate(scenarios: DataFrame, states: Sequence[str], flow: Callable[[float, np.ndarray, dict], np.ndarray], steps: int, dt: float, noise: float = 0.0, seed: int = 19) -> DataFrame:
    """RK4 (or Euler-Maruyama with ``noise``) trajectories of scenario rows: (scenario, replicate, step, time, states).

    Each row holds scenario, replicate, the initial states and parameters; ``flow(t, x, row)`` is
    the derivative.  Noise is keyed by replicate and step, so scenarios share it.
    """

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.array([row[s] for s in states], float)
                out = [x]
                for k in range(steps):
                    t = k * dt
                    if noise:
                        rng = np.random.Generator(np.random.Philox(key=[seed, int(row["replicate"]) * (steps + 1) + k]))
                        x = x + dt * flow(t, x, row) + noise * np.sqrt(dt) * rng.normal(size=len(x))
                    else:
                        a = flow(t, x, row)
                        b = flow(t + dt / 2, x + dt / 2 * a, row)
                        c = flow(t + dt / 2, x + dt / 2 * b, row)
                        x = x + dt / 6 * (a + 2 * b + 2 * c + flow(t + dt, x + dt * c, row))
                    out.append(x)
                grid = np.arange(steps + 1)
                yield pd.DataFrame({"scenario": [row["scenario"]] * len(grid), "replicate": row["replicate"], "step": grid, "time": grid * dt, **{s: np.array(out)[:, i] for i, s in enumerate(states)}})

    return scenarios.mapInPandas(run, "scenario string, replicate long, step int, time double, " + ", ".join(f"{s} double" for s in states))


def what_if(parameters: DataFrame, baseline: str, name: str, clamp: dict[str, float]) -> DataFrame:
    """The baseline scenario's rows and a copy of them with some parameters clamped."""
    base = parameters.where(F.col("scenario") == baseline)
    return base.unionByName(base.withColumns({"scenario": F.lit(name), **{k: F.lit(v) for k, v in clamp.items()}}))


def ablate(edges: DataFrame) -> DataFrame:
    """Couplings and the same with every weight zero, as two scenarios."""
    return edges.withColumn("scenario", F.lit("coupled")).unionByName(edges.withColumns({"scenario": F.lit("uncoupled"), "weight": F.lit(0.0)}))


def influence(nodes: DataFrame, edges: DataFrame, steps: int, spark: SparkSession, noise: float = 0.05, seed: str = "23") -> DataFrame:
    """(node, step, x): bounded influence, x' = sigmoid(4 (sum w (x - 1/2) + drift + noise)).

    ``nodes`` (node, x, drift), ``edges`` (src, dst, weight); every step is one join and is written.
    """
    store = Store(spark, "influence")
    state = store.put(nodes.select("node", F.lit(0).alias("step"), F.col("x").cast("double").alias("x"), "drift"))
    edges = store.put(edges.select("src", "dst", "weight"))
    out = state
    for k in range(1, steps + 1):
        pull = edges.join(state.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * (F.col("x") - 0.5)).alias("p"))
        shake = noise * (uniform(seed, F.col("node"), F.lit(k)) - 0.5)
        new = state.join(pull, "node", "left").select("node", F.lit(k).alias("step"), (1 / (1 + F.exp(-4 * (F.coalesce("p", F.lit(0.0)) + F.col("drift") + shake)))).alias("x"), "drift")
        state = store.put(new)
        out = out.unionByName(state)
    return out.select("node", "step", "x")


def ablation(nodes: DataFrame, edges: DataFrame, steps: int, spark: SparkSession, **options) -> DataFrame:
    """(node, coupled, uncoupled, difference) after ``steps``: a run against the same without couplings.

    Both runs share their noise, so the difference is what the couplings do.
    """
    both = ablate(edges)
    last = [influence(nodes, both.where(F.col("scenario") == name), steps, spark, **options).where(F.col("step") == steps).select("node", F.col("x").alias(name)) for name in ("coupled", "uncoupled")]
    return last[0].join(last[1], "node").withColumn("difference", F.col("coupled") - F.col("uncoupled"))


def cascade(edges: DataFrame, seeds: DataFrame, spark: SparkSession, steps: int, replicates: int = 1, hazard: float = 0.1, threshold: int | None = None, seed: str = "29") -> DataFrame:
    """(replicate, node, step) of first activation on directed (src, dst) edges.

    Independent cascade: a newly active node tries each edge once, with probability
    ``hazard``.  With ``threshold``, complex contagion: a node follows when so many active
    neighbours point at it.  Every step is written.
    """
    store = Store(spark, "cascade")
    edges = store.put(edges.select("src", "dst").distinct())
    active = store.put(seeds.select("node").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("replicate", "node", F.lit(0).alias("step")))
    for k in range(1, steps + 1):
        tried = active if threshold is not None else active.where(F.col("step") == k - 1)
        hits = tried.select("replicate", F.col("node").alias("src")).join(edges, "src")
        if threshold is not None:
            new = hits.groupBy("replicate", F.col("dst").alias("node")).agg(F.count("*").alias("c")).where(F.col("c") >= threshold).select("replicate", "node")
        else:
            new = hits.where(uniform(seed, F.col("replicate"), F.col("src"), F.col("dst")) < hazard).select("replicate", F.col("dst").alias("node")).distinct()
        new = new.join(active, ["replicate", "node"], "left_anti").withColumn("step", F.lit(k))
        found = store.put(active.unionByName(new))
        if found.where(F.col("step") == k).isEmpty():
            return found
        store.drop(active)
        active = found
    return active


def cascade_stats(active: DataFrame, group: str, at: str, degrees: DataFrame | None = None) -> DataFrame:
    """Size, duration, half time, mean and spread of activation ages, peak step and share of the first tenth."""
    ends = active.groupBy(group).agg(F.min(at).alias("_start"), F.max(at).alias("_end"), F.count("*").alias("_n"))
    per = active.groupBy(group, at).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.join(ends, group).withColumns({"age": F.col(at) - F.col("_start"), "so_far": F.sum("k").over(w)})
    age, k = F.col("age"), F.col("k")
    mean = F.sum(age * k) / F.sum(k)
    return rows.groupBy(group).agg(
        F.first("_n").alias("size"), F.max("age").alias("duration"), F.min(F.when(2 * F.col("so_far") >= F.col("_n"), age)).alias("half_time"), mean.alias("mean_age"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(age * age * k) / F.sum(k) - mean * mean)).alias("age_spread"), F.max("k").alias("peak"), F.min_by("age", F.struct(-k, age)).alias("peak_age"),
        (F.sum(F.when(age <= 0.1 * (F.col("_end") - F.col("_start")), k).otherwise(0)) / F.sum(k)).alias("early_share"),
    )
