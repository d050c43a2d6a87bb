"""Streams: the availability rule as a watermark, and rolling bounds checks.

Extensions: the library's batch operators have no streaming counterpart to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admitted(stream: DataFrame, observed: str, available: str, delay: str) -> DataFrame:
    """Rows that were available within ``delay`` of being observed; later ones are dropped with the watermark."""
    return stream.withWatermark(observed, delay).where(F.col(available) <= F.col(observed) + F.expr(f"INTERVAL {delay}"))


def rolling_bounds(stream: DataFrame, time: str, group: str, value: str, lower: float, upper: float, width: str, delay: str | None = None) -> DataFrame:
    """Per window and group: rows, violations and the worst of them; ``delay`` unless the stream has a watermark."""
    v = F.greatest(F.lit(0.0), F.lit(lower) - F.col(value), F.col(value) - F.lit(upper))
    return (
        (stream.withWatermark(time, delay) if delay else stream).groupBy(F.window(time, width), group)
        .agg(F.count("*").alias("n"), F.count_if(v > 0).alias("violations"), F.max(v).alias("worst"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), group, "n", "violations", "worst")
    )


def upsert_latest(target: str):
    """A ``foreachBatch`` sink that keeps the last row of every key in append-only files."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(target)

    return put


def latest(stored: DataFrame, key: str, order: str) -> DataFrame:
    """The newest stored row of every key; a replayed epoch changes nothing."""
    columns = [c for c in stored.columns if c != key]
    return stored.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "epoch")).alias("r")).select(key, "r.*")
