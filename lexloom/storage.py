"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel to the Python workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["lexloom"])

#: Input bytes that are worth a task of their own where there are idle cores.
SPREAD_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master (tests, one machine), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lexloom-scratch")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/lexloom/{spark.sparkContext.applicationId}"
    fs, at = hadoop_path(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def version_of(spark: SparkSession, path: str) -> tuple:
    """What changes when a file or folder is written again: its size and time."""
    fs, at = hadoop_path(spark, path)
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def spread(table: DataFrame) -> DataFrame:
    """A small table of few files dealt out to all cores; a table with work for all of them as it is."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if cores > 1 and SPREAD_BYTES < size < cores * 16 * SPREAD_BYTES else table


#: Bytes of a part that rows are dealt out to, by Spark's estimate from the files' sizes.
PART_BYTES = 4 << 20


def dealt_by(table: DataFrame, *keys, part_bytes: int = PART_BYTES) -> DataFrame:
    """A table dealt out by its keys, to parts that don't grow with it where its size is known."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known
        return table.repartition(*keys)
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), *keys)


def lies_by(table: DataFrame, key: str) -> bool:
    """Whether equal keys lie in one part already, as they do behind dealt_by and joins by broadcast."""
    return f"hashpartitioning({key}#" in str(table._jdf.queryExecution().sparkPlan().outputPartitioning().toString())


#: Rows of narrow columns that may be sent to every task.
SMALL_ROWS = 200_000


def if_small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table of narrow rows, to be broadcast if it has at most `most` rows, else to be joined by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")
