"""Declarative data-quality checks: specs are data, checks compile to columns.

Row-wise checks of one table share one scan and one aggregate; order-dependent
ones add a window over their group.  A cell counts as a number if it casts to a
finite double.  An empty selection never passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("finite", "bounds", "sum_conservation", "monotonic")
REPORT = (
    "check_id string, operation string, selected_row_count long, group_count long, comparison_count long, "
    "violation_count long, observed_worst_violation double, worst_excess double, passed boolean"
)


@dataclass(frozen=True)
class NumericCheck:
    id: str
    operation: str
    columns: tuple[str, ...]
    group_columns: tuple[str, ...] = ()
    time_column: str | None = None
    row_filters: tuple[tuple[str, str], ...] = ()
    lower: float | None = None
    upper: float | None = None
    reference_value: float | None = None
    tolerance: float = 0.0
    direction: str | None = None
    tie_columns: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.operation not in OPERATIONS or not self.columns or self.tolerance < 0:
            raise ValueError(f"{self.id}: unknown operation, no columns or a negative tolerance")
        needs = {
            "bounds": self.lower is not None or self.upper is not None,
            "sum_conservation": self.reference_value is not None,
            "monotonic": self.direction in ("increasing", "decreasing") and self.time_column is not None,
        }
        if not needs.get(self.operation, True):
            raise ValueError(f"{self.id}: {self.operation} lacks what it compares with")


def number(col: str) -> Column:
    x = F.col(col).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def selected(df: DataFrame, filters: Sequence[tuple[str, str]]) -> Column:
    """Conjunction of exact string equalities; no filter selects every row."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string") == v, F.lit(False)) for c, v in filters], F.lit(True))


def _violation(check: NumericCheck, col: str) -> Column:
    x = number(col)
    sides = [F.lit(0.0)]
    if check.lower is not None:
        sides.append(F.lit(check.lower) - x)
    if check.upper is not None:
        sides.append(x - F.lit(check.upper))
    return F.when(x.isNotNull(), F.greatest(*sides)) if len(sides) > 1 else F.when(x.isNotNull(), F.lit(0.0))


def _rowwise(df: DataFrame, checks: Sequence[NumericCheck]) -> DataFrame:
    aggs, rows = [], []
    for k, c in enumerate(checks):
        on = selected(df, c.row_filters)
        if c.operation == "sum_conservation":
            cells = [F.abs(reduce(lambda a, b: a + b, [number(x) for x in c.columns]) - F.lit(c.reference_value))]
        elif c.operation == "bounds":
            cells = [_violation(c, x) for x in c.columns]
        else:
            cells = [F.when(number(x).isNotNull(), F.lit(0.0)) for x in c.columns]
        bad = lambda v: F.when(on & (v.isNull() | (v > c.tolerance)), 1).otherwise(0)
        groups = F.countDistinct(F.when(on, F.struct(*c.group_columns))) if c.group_columns else F.max(F.when(on, 1).otherwise(0))
        aggs += [
            F.count_if(on).alias(f"n{k}"),
            groups.cast("long").alias(f"g{k}"),
            F.sum(reduce(lambda a, b: a + b, [bad(v) for v in cells])).alias(f"v{k}"),
            F.max(F.when(on, F.greatest(*cells) if len(cells) > 1 else cells[0])).alias(f"w{k}"),
        ]
        worst = F.coalesce(f"w{k}", F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(c.id).alias("check_id"), F.lit(c.operation).alias("operation"), F.col(f"n{k}").alias("selected_row_count"), F.col(f"g{k}").alias("group_count"),
                (F.col(f"n{k}") * len(cells)).alias("comparison_count"), F.coalesce(f"v{k}", F.lit(0)).cast("long").alias("violation_count"), worst.alias("observed_worst_violation"),
                F.greatest(F.lit(0.0), worst - c.tolerance).alias("worst_excess"), ((F.col(f"n{k}") > 0) & (F.col(f"v{k}") == 0)).alias("passed"),
            )
        )
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def monotonic(df: DataFrame, check: NumericCheck) -> DataFrame:
    """Per group in time order: how far each value falls behind the running extreme."""
    sign = 1.0 if check.direction == "increasing" else -1.0
    rows = df.where(selected(df, check.row_filters))
    group = F.struct(*check.group_columns) if check.group_columns else F.lit(0)
    cells = rows.select(group.alias("g"), F.col(check.time_column).alias("t"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(check.tie_columns)], F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (sign * number(c)).alias("x")) for c in check.columns])).alias("cell"))
    before = Window.partitionBy("g", "cell.c").orderBy("t", *[f"tie{i}" for i in range(len(check.tie_columns))]).rowsBetween(Window.unboundedPreceding, -1)
    fall = cells.select("g", F.col("cell.x").alias("x"), F.max("cell.x").over(before).alias("top"), F.count(F.lit(1)).over(before).alias("k")).withColumn(
        "v", F.when(F.col("k") > 0, F.when(F.col("x").isNull() | F.col("top").isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), F.col("top") - F.col("x"))))
    )
    worst = F.coalesce(F.max("v"), F.lit(0.0))
    n, n_cols = F.count(F.lit(1)), len(check.columns)
    return fall.agg(
        F.lit(check.id).alias("check_id"), F.lit("monotonic").alias("operation"), (n / n_cols).cast("long").alias("selected_row_count"), F.countDistinct("g").alias("group_count"),
        F.count("v").alias("comparison_count"), F.count_if(F.col("v") > check.tolerance).alias("violation_count"), worst.alias("observed_worst_violation"),
        F.greatest(F.lit(0.0), worst - check.tolerance).alias("worst_excess"), ((n > 0) & (F.count_if(F.col("v") > check.tolerance) == 0)).alias("passed"),
    )


def run(df: DataFrame, checks: Sequence[NumericCheck]) -> DataFrame:
    """One report row per check; row-wise checks share one pass over ``df``."""
    if len({c.id for c in checks}) != len(checks):
        raise ValueError("check ids repeat")
    plain = [c for c in checks if c.operation != "monotonic"]
    parts = ([_rowwise(df, plain)] if plain else []) + [monotonic(df, c) for c in checks if c.operation == "monotonic"]
    return reduce(DataFrame.unionByName, parts)


def examples(df: DataFrame, check: NumericCheck, order: Sequence[str], most: int = 5) -> DataFrame:
    """The first violating cells of a bounds check in ``order``."""
    cells = df.where(selected(df, check.row_filters)).select(*order, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _violation(check, c).alias("violation")) for c in check.columns])).alias("e"))
    return cells.select(*order, "e.column", "e.violation").where(F.col("violation") > check.tolerance).orderBy(*order, "column").limit(most)


def duplicate_times(df: DataFrame, groups: Sequence[str], time: str) -> DataFrame:
    """Group and time pairs that occur more than once."""
    return df.groupBy(*groups, time).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def violation_report(df: DataFrame, step: str, constraints: dict[str, Column], tolerance: float = 0.0) -> DataFrame:
    """Per named violation column: max, mean, violating steps, share, first violating step."""
    v = F.col("c.v")
    cells = df.select(step, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(0.0), c).alias("v")) for k, c in constraints.items()])).alias("c"))
    return cells.groupBy(F.col("c.name").alias("constraint_name")).agg(
        F.max(v).alias("max_violation"), F.avg(v).alias("mean_violation"), F.count_if(v > tolerance).alias("violating_steps"),
        (F.count_if(v > tolerance) / F.count("*")).alias("violating_fraction"), F.min(F.when(v > tolerance, F.col(step))).alias("first_step"),
    )


def monotone_repair(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, increasing: bool = True) -> DataFrame:
    """``repaired``: the running maximum (or minimum) of each group."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("repaired", (F.max if increasing else F.min)(value).over(w))


def require(report: DataFrame) -> None:
    """Raises if any check of a report did not pass."""
    failed = [r.check_id for r in report.where("NOT passed").select("check_id").orderBy("check_id").limit(32).collect()]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")
