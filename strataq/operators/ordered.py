"""Global order without a single task: running sums, exact quantiles, lags of hot series.

Values are counted first, so what is ordered are distinct values.  Cut points (at most
``PARTS``) split them into ranges that are windows of their own; what lies in the ranges
before comes from one total per range.  Series with few keys and many rows are cut into
buckets of time, and the last row before a bucket comes from one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def cut_points(df: DataFrame, value: str, parts: int = PARTS) -> list[float]:
    """About evenly filled ranges: any cuts are right, they only share out the work."""
    got = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0]
    return sorted(set(got or []))


def running(counts: DataFrame, value: str, *sums: str, groups: Sequence[str] = ()) -> DataFrame:
    """``counts`` (one row per group and value) with ``<sum>_before``: the sum over smaller values of the group."""
    cuts = cut_points(counts, value)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    rows = counts.withColumn("_part", part)
    totals = rows.groupBy(*groups, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])  # PARTS rows per group at most
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return rows.join(totals, [*groups, "_part"]).select(*counts.columns, *[(F.col(f"_i_{s}") + F.col(f"_o_{s}")).alias(f"{s}_before") for s in sums])


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("k"))


def quantiles(df: DataFrame, value: str, at: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation at position (n - 1) * f, one row per group."""
    r = running(value_counts(df, value, groups), value, "k", groups=groups)
    n = r.groupBy(*groups).agg(F.sum("k").alias("_n"))
    r = r.join(n, list(groups)) if groups else r.crossJoin(n)  # one row
    x, first, after = F.col(value), F.col("k_before"), F.col("k_before") + F.col("k")

    def spot(f: float, whole) -> Column:
        i = whole(f * (F.col("_n") - 1))
        return F.max(F.when((first <= i) & (i < after), x))

    picks = {name: (spot(f, F.floor), spot(f, F.ceil)) for name, f in at.items()}
    out = r.groupBy(*groups).agg(F.first("_n").alias("_n"), *[c.alias(f"_{side}_{name}") for name, pair in picks.items() for side, c in zip("ab", pair)])
    rest = {name: f * (F.col("_n") - 1) - F.floor(f * (F.col("_n") - 1)) for name, f in at.items()}
    return out.select(*groups, *[(F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * rest[name]).alias(name) for name in at])


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """value to its average rank (ties share it) and count."""
    r = running(value_counts(df, value, groups), value, "k", groups=groups)
    return r.select(*groups, value, (F.col("k_before") + (F.col("k") + 1) / 2).alias("rank"))


def tail_mean(df: DataFrame, group: str, x: str, alpha: float = 0.9) -> DataFrame:
    """Mean and number of the values from position floor(alpha * n) of each group on."""
    r = running(value_counts(df, x, [group]), x, "k", groups=[group])
    r = r.join(r.groupBy(group).agg(F.sum("k").alias("_n")), group)
    taken = F.col("k") - F.least(F.col("k"), F.greatest(F.lit(0), F.floor(F.col("_n") * alpha) - F.col("k_before")))
    return r.groupBy(group).agg((F.sum(taken * F.col(x)) / F.sum(taken)).alias("cvar"), F.sum(taken).alias("n_tail"))


def lagged(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], values: dict[str, str], bucket: float = 3600.0) -> DataFrame:
    """``df`` with the values of the row before it in its series, by (time, ties).

    ``time`` is a number; series are cut into buckets of ``bucket`` of its units.
    """
    order = [time, *ties]
    rows = df.withColumn("_bucket", F.floor(F.col(time) / bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = rows.groupBy(*keys, "_bucket").agg(F.max(F.struct(*dict.fromkeys([*order, *values.values()]))).alias("_last"))  # one row per bucket
    before = last.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_held"))
    rows = rows.withColumns({"_k": F.row_number().over(inside), **{name: F.lag(c).over(inside) for name, c in values.items()}})
    rows = rows.join(before, [*keys, "_bucket"])
    return rows.select(*df.columns, *[F.when(F.col("_k") == 1, F.col("_held")[c]).otherwise(F.col(name)).alias(name) for name, c in values.items()])
