"""Intermediate tables in the folder that the whole cluster shares.

Every table is written with Spark's own commit protocol under ``spark.checkpoint.dir``, so a lost
executor costs a retry of its tasks and nothing else. Where a local session has no such folder (tests,
notebooks) a temporary one is made and set, once for each session; a cluster must name one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in the session's ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="gritsieve-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        _OPEN.append((spark, root))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")  # with its scheme, for readers outside Spark


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder of intermediate tables that belong to one call of one operator.

    Tables that the returned DataFrame still reads must outlive the call, so they go when Python
    exits; those that are no longer needed go early, through ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _OPEN.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def stash(self, df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends there and the size is known to the planner."""
        writer = df.write.mode("overwrite")
        if compression:
            writer = writer.option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


@atexit.register
def _close() -> None:
    for spark, path in _OPEN:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            return
