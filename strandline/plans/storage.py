"""Intermediate tables kept in the cluster's shared folder."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is absent and the whole
    session runs on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/strandline-{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str = "table") -> DataFrame:
    """Write a table once and read it back: lineage ends, nothing is recomputed."""
    return stored_at(table, scratch_path(table.sparkSession, name))


def stored_at(table: DataFrame, path: str) -> DataFrame:
    """As ``stored``, at a path that the caller may ``discard`` when nothing reads it any more."""
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Let shuffle files go that no plan can read any more.

    Spark drops them when the driver's JVM collects its garbage, which on a large heap may be after
    the job; until then they fill the executors' disks. Worth a collection after a step that
    shuffles much and is stored.
    """
    gc.collect()  # Python's tables hold plans, too
    spark.sparkContext._jvm.System.gc()
