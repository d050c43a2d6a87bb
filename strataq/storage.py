"""Tables in the folder that driver and executors share: they cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where it is unset (local sessions, as in tests).
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("strataq.local.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataq-")
        spark.conf.set("strataq.local.dir", root)
    return root.rstrip("/")


class Store:
    """Written tables of one run: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def part(self, name: str) -> "Store":
        """A store in a folder of this one, which can be cleared as a whole."""
        inner = Store(self.spark, name)
        inner.root = f"{self.root}/{name}"
        return inner

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._strataq_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing lazy reads any more."""
        for df in tables:
            self._delete(df._strataq_path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished steps.

        They stay as long as the driver's JVM holds plans that nothing refers to any more,
        else until it happens to collect its garbage.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Deletes every table of this store."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
