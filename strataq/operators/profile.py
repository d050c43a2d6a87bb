"""Table, column and text profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, present and distinct values, least and greatest number of each column.

    Each column is counted by value first, from a scan of that column alone.
    """
    parts = []
    for c in columns or df.columns:
        per = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k"))
        parts.append(per.agg(F.sum("k").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0)).alias("n_present"), F.count("v").alias("n_distinct"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high")).select(F.lit(c).alias("column_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_present", F.lit(0)).alias("n_present"), "n_distinct", "low", "high"))
    return reduce(DataFrame.unionByName, parts)


def text_profile(df: DataFrame, text: str, group: str) -> DataFrame:
    """Size and shape of the texts of each group."""
    x = F.col(text)
    return df.groupBy(group).agg(
        F.count("*").alias("n_texts"), F.sum(F.length(x)).alias("n_chars"), F.sum(F.size(F.split(x, "\n"))).alias("n_lines"),
        F.max(F.length(x)).cast("long").alias("longest"), F.count_if(F.contains(x, F.lit("\0"))).alias("n_binary"),
    )


def numeric_columns(df: DataFrame) -> DataFrame:
    """Columns whose every trimmed cell parses as a number ('nan' and 'inf' do)."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count(F.trim(F.col(c).cast("string")).try_cast("double")).alias(f"k{i}") for i, c in enumerate(df.columns)]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"k{i}").alias("n_numeric"), (F.col("n") == F.col(f"k{i}")).alias("is_numeric")) for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
