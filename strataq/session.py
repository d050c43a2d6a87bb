"""Session defaults and access to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "strataq", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


class Tables:
    """``tables.orders`` reads ``<folder>/orders.parquet`` lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def epoch(col: str | Column) -> Column:
    """Seconds since 1970 as a double, for either timestamp type."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp").cast("double")


def day(col: str | Column) -> Column:
    """Whole days since 1970."""
    return F.unix_date((F.col(col) if isinstance(col, str) else col).cast("date")).cast("long")


def r6(col: Column) -> Column:
    """Rounded to six places; sums of doubles differ in their last bits between plans."""
    return F.round(col, 6) + F.lit(0.0)
