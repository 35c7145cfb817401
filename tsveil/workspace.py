"""Tables that cut lineage, and joins whose small side is counted before it is broadcast."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the counted side of a join is broadcast; above, both sides are shuffled.
BROADCAST_ROWS = 400_000


class Workspace:
    """Parquet tables under spark.checkpoint.dir, which driver and executors share; the JVM deletes them when it ends.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that raises a RuntimeError, as executors wouldn't share it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="tsveil-")
            spark.sparkContext.setCheckpointDir(root)
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._fs(self.path).deleteOnExit(self._path(self.path))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and has the JVM free the shuffle files of plans that are gone."""
        for name in names:
            path = f"{self.path}/{name}"
            self._fs(path).delete(self._path(path), True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
