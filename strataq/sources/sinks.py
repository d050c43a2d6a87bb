"""Sinks: content-addressed append, trajectory and case CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store


def addressed(records: DataFrame, data: str) -> DataFrame:
    """Adds ``digest``: SHA-256 of the record's JSON text."""
    return records.withColumn("digest", F.sha2(F.col(data).cast("binary"), 256))


def append_new(records: DataFrame, path: str, data: str = "data") -> int:
    """Appends records whose digest is not stored yet, one file group per kind; the number written.

    What is new is found once, written beside and then appended.  Two writers may append one
    digest at the same time; ``stored`` reads every digest once, so that does not show.
    """
    spark = records.sparkSession
    new = addressed(records, data).dropDuplicates(["digest"])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    store = Store(spark, "append")
    new = store.put(new)
    if n := new.count():
        new.write.mode("append").partitionBy("kind").parquet(path)
    store.clear()
    return n


def stored(spark: SparkSession, path: str, data: str = "data") -> DataFrame:
    """Records of a content-addressed folder, each digest once; a record that does not match its digest is an error."""
    rows = spark.read.parquet(path)
    intact = F.sha2(F.col(data).cast("binary"), 256) == F.col("digest")
    return rows.withColumn("digest", F.when(intact, F.col("digest")).otherwise(F.raise_error(F.lit("a record does not match its digest")).cast("string"))).dropDuplicates(["digest"])


def trajectory(long: DataFrame, states: list[str]) -> DataFrame:
    """(time, scenario, replicate, state, value) to one column per stated state."""
    return long.groupBy("time", "scenario", "replicate").pivot("state", states).agg(F.first("value"))


def trajectory_text(long: DataFrame, states: list[str]) -> DataFrame:
    """The same as one row per group of CSV lines: header and lines in order of scenario, replicate, time."""
    wide = trajectory(long, states)
    cells = F.concat_ws(",", *[F.col(c).cast("string") for c in ("time", "scenario", "replicate", *states)])
    lines = wide.select("scenario", "replicate", F.struct("time", cells.alias("line")).alias("r")).groupBy("scenario", "replicate").agg(F.sort_array(F.collect_list("r")).alias("r"))
    head = ",".join(["time", "scenario", "replicate", *states])
    return lines.select("scenario", "replicate", F.concat_ws("\n", F.lit(head), F.array_join("r.line", "\n")).alias("csv"))


def write_case_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """CSV with a header, nulls as empty cells and doubles of four places."""
    doubles = {c for c, kind in df.dtypes if kind in ("double", "float")}
    df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
