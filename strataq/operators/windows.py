"""Ordered-sequence operators: rolling moments, sequential tests, segments, kernels.

Windows are partitioned by a series key, so tasks grow with one series at most.
Closed forms stay in the JVM; kernels that need a fold over a whole ordered
series run per series through ``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, key: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """Variance (ddof 1), population skewness and lag-1 autocorrelation of full trailing windows."""
    w = Window.partitionBy(key).orderBy(*order)
    span = w.rowsBetween(1 - width, 0)
    x = F.col(value)
    m = lambda k: F.avg(F.pow(x, F.lit(float(k)))).over(span)
    df = df.withColumns({"n_in": F.count(x).over(span), "m1": m(1), "m2": m(2), "m3": m(3), "xs": F.collect_list(x).over(span)})
    var = F.greatest(F.lit(0.0), F.col("m2") - F.col("m1") ** 2)
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.col("m1") ** 3
    c = F.transform("xs", lambda v: v - F.col("m1"))
    pairs = F.zip_with(F.slice(c, 1, width - 1), F.slice(c, 2, width - 1), lambda a, b: a * b)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = df.where(F.col("n_in") == width).withColumns({"variance": var * width / (width - 1), "skewness": third / F.nullif(F.pow(var, F.lit(1.5)), F.lit(0.0))})
    return out.withColumn("acf", total(pairs) / F.nullif(total(F.transform(c, lambda v: v * v)), F.lit(0.0))).drop("n_in", "m1", "m2", "m3", "xs")


def phases(df: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Maximal runs of an unchanged state: number, start, end, length."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    marked = df.withColumn("_c", changed).withColumn("phase", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "phase", state).agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count("*").alias("length"))


def runs_test(df: DataFrame, key: str, order: Sequence[str], residual: str, least: int = 8) -> DataFrame:
    """Wald-Wolfowitz runs test of signs; zeros are dropped, short series left out."""
    w = Window.partitionBy(key).orderBy(*order)
    s = df.where(F.col(residual) != 0).select(key, *order, F.signum(residual).alias("s"))
    s = s.withColumn("start", F.when(F.col("s") == F.lag("s").over(w), 0).otherwise(1))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    g = s.groupBy(key).agg(F.sum("start").alias("runs"), F.count_if(F.col("s") > 0).alias("pos"), F.count_if(F.col("s") < 0).alias("neg")).where(F.col("pos") + F.col("neg") >= least)
    n = a + b
    mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return g.withColumn("z", (F.col("runs") - mean) / F.sqrt(F.nullif(var, F.lit(0.0))))


def ljung_box(df: DataFrame, key: str, order: Sequence[str], value: str, lags: int) -> DataFrame:
    """Q statistic over the first lags; shifts are window reads, not self joins."""
    w = Window.partitionBy(key).orderBy(*order)
    mean, n = F.avg(value).over(Window.partitionBy(key)), F.count(value).over(Window.partitionBy(key))
    c = df.select(key, *order, (F.col(value) - mean).alias("c"), n.alias("n"))
    c = c.withColumns({f"p{k}": F.col("c") * F.lag("c", k).over(w) for k in range(1, lags + 1)})
    g = c.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("c") ** 2).alias("d"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(1, lags + 1)])
    q = sum(((F.col(f"s{k}") / F.col("d")) ** 2 / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return g.select(key, "n", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def ewma(df: DataFrame, key: str, order: Sequence[str], value: str, age: Column, keep: Column, decay: float = 0.94) -> DataFrame:
    """Weighted mean of each series with weight decay ** age; rows outside ``keep`` are left out."""
    w = F.pow(F.lit(decay), age)
    return df.where(keep).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("ewma"), F.count("*").alias("n"))


def mixture_sprt(df: DataFrame, key: str, order: Sequence[str], effect: str, sigma: float, tau: float, alpha: float) -> DataFrame:
    """Running mean, mixture log likelihood ratio, always-valid p and the first crossing."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s2, t2 = sigma * sigma, tau * tau
    out = df.withColumns({"k": F.count(effect).over(w), "mean": F.avg(effect).over(w)})
    llr = 0.5 * F.log(s2 / (s2 + F.col("k") * t2)) + F.col("k") * F.col("k") * t2 * F.col("mean") ** 2 / (2 * s2 * (s2 + F.col("k") * t2))
    out = out.withColumn("llr", llr).withColumn("p", F.least(F.lit(1.0), F.exp(-F.max("llr").over(w))))
    return out.groupBy(key).agg(F.max("k").alias("n"), F.min("p").alias("p"), F.min(F.when(F.col("p") <= alpha, F.col("k"))).alias("crossed_at"), F.max_by("mean", "k").alias("mean"))


def crowding(df: DataFrame, key: str, objectives: Sequence[str], tie: str) -> DataFrame:
    """NSGA-II crowding: summed neighbour gaps over each range; extremes have none."""
    d = F.lit(0.0)
    edge = F.lit(False)
    for c in objectives:
        w, g = Window.partitionBy(key).orderBy(c, tie), Window.partitionBy(key)
        span = F.max(c).over(g) - F.min(c).over(g)
        lo, hi = F.lag(c).over(w), F.lead(c).over(w)
        edge = edge | lo.isNull() | hi.isNull()
        d = d + F.coalesce((hi - lo) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"_d": d, "_e": edge}).withColumn("crowding", F.when(~F.col("_e"), F.col("_d"))).drop("_d", "_e")


def gradient(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Derivative on a non-uniform grid: second order inside, one-sided at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    t, x = F.col(order), F.col(value)
    a, b = t - F.lag(order).over(w), F.lead(order).over(w) - t
    back, ahead = (x - F.lag(value).over(w)) / a, (F.lead(value).over(w) - x) / b
    return df.withColumn("slope", F.coalesce((back * b + ahead * a) / (a + b), ahead, back))


def best_split(df: DataFrame, key: str, order: Sequence[str], value: str, least: int) -> DataFrame:
    """The single mean change with the least residual sum of squares; the earliest wins."""
    w = Window.partitionBy(key).orderBy(*order)
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    x = F.col(value)
    s = df.select(key, F.row_number().over(w).alias("at"), F.count("*").over(every).alias("n"), F.sum(x).over(upto).alias("s"), F.sum(x * x).over(upto).alias("q"), F.sum(x).over(every).alias("ts"), F.sum(x * x).over(every).alias("tq"))
    rss = (F.col("q") - F.col("s") ** 2 / F.col("at")) + (F.col("tq") - F.col("q") - (F.col("ts") - F.col("s")) ** 2 / (F.col("n") - F.col("at")))
    s = s.where((F.col("at") >= least) & (F.col("n") - F.col("at") >= least)).withColumn("rss", F.round(rss, 6))
    return s.groupBy(key).agg(F.min(F.struct("rss", "at")).alias("m"), F.first("tq").alias("tq"), F.first("ts").alias("ts"), F.first("n").alias("n")).select(
        key, F.col("m.at").alias("split_at"), F.col("m.rss").alias("rss"), (F.col("tq") - F.col("ts") ** 2 / F.col("n") - F.col("m.rss")).alias("gain")
    )


# Parameters of a segment (mean and variance), least size and most segments.
PARAMETERS, LEAST_SIZE, MOST_SEGMENTS = 2, 5, 6


def segments(values: np.ndarray, least: int = LEAST_SIZE, most: int = MOST_SEGMENTS, penalty: float | None = None) -> list[int]:
    """Change points by greedy binary segmentation under a Gaussian cost.

    Each round takes the best split of all segments, the earliest of equals, while it lowers
    the cost by more than the penalty: (parameters + 1) ln n unless stated.
    """
    x = np.asarray(values, float)
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    floor = 1e-12 * max(1.0, float(x.var()) if n else 1.0)

    def cost(a, b):
        return (b - a) * np.log(np.maximum(np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a), 0) / (b - a), floor))

    penalty = (PARAMETERS + 1) * np.log(max(n, 1)) if penalty is None else penalty
    ends = [0, n]
    while len(ends) - 1 < most:
        best = (-np.inf, 0)
        for a, b in zip(ends, ends[1:]):
            k = np.arange(a + least, b - least + 1)
            if len(k):
                gain = cost(a, b) - (cost(a, k) + cost(k, b))
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), int(k[i])), key=lambda g: g[0])
        if best[0] <= penalty:
            break
        ends = sorted([*ends, best[1]])
    return ends[1:-1]


def regime_segments(df: DataFrame, key: str, order: Sequence[str], value: str, least: int = LEAST_SIZE, most: int = MOST_SEGMENTS) -> DataFrame:
    def step(pdf):
        pdf = pdf.sort_values(list(order), kind="stable")
        x = pdf[value].to_numpy(float)
        ends = [0, *segments(x, least, most), len(x)]
        return pd.DataFrame({"series": [str(pdf[key].iloc[0])] * (len(ends) - 1), "start": ends[:-1], "stop": ends[1:], "mean": [x[a:b].mean() for a, b in zip(ends, ends[1:])]})

    return df.select(key, *order, value).groupBy(key).applyInPandas(step, "series string, start long, stop long, mean double")


def pava(values: np.ndarray, weights: np.ndarray, increasing: bool = False) -> np.ndarray:
    """Weighted isotonic fit by pooling adjacent violators."""
    sign = 1.0 if increasing else -1.0
    blocks: list[list[float]] = []
    for v, w in zip(sign * np.asarray(values, float), weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, k2 = blocks.pop()
            v1, w1, k1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return sign * np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def isotonic(df: DataFrame, key: str, threshold: str, value: str) -> DataFrame:
    """Non-increasing fit of ``value`` over ``threshold`` per key; equal thresholds are pooled first."""
    pooled = df.groupBy(key, threshold).agg(F.avg(value).alias("raw"), F.count("*").alias("w"))

    def step(pdf):
        pdf = pdf.sort_values(threshold)
        return pdf.assign(fit=pava(pdf.raw.to_numpy(), pdf.w.to_numpy()))[[key, threshold, "raw", "w", "fit"]]

    kind = dict(pooled.dtypes)
    return pooled.groupBy(key).applyInPandas(step, f"{key} {kind[key]}, {threshold} {kind[threshold]}, raw double, w long, fit double")


def kendall(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b per key, by sorting and counting inversions."""

    def inversions(a: list) -> int:
        if len(a) < 2:
            return 0
        m = len(a) // 2
        left, right = a[:m], a[m:]
        n = inversions(left) + inversions(right)
        i = j = 0
        for k in range(len(a)):
            if j == len(right) or i < len(left) and left[i] <= right[j]:
                a[k] = left[i]
                i += 1
            else:
                a[k] = right[j]
                n += len(left) - i
                j += 1
        return n

    def ties(v) -> int:
        _, c = np.unique(v, return_counts=True, axis=0)
        return int((c * (c - 1) // 2).sum())

    def step(pdf):
        a, b = pdf[x].to_numpy(), pdf[y].to_numpy()
        n0 = len(a) * (len(a) - 1) // 2
        order = np.lexsort((b, a))
        ta, tb, tab = ties(a), ties(b), ties(np.stack([a, b], 1))
        down = inversions(b[order].tolist())
        up = n0 - down - ta - tb + tab
        size = np.sqrt(float(n0 - ta) * float(n0 - tb))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "tau": [(up - down) / size if size else None], "n": [len(a)]})

    return df.select(key, x, y).groupBy(key).applyInPandas(step, f"{key} {dict(df.dtypes)[key]}, tau double, n long")
