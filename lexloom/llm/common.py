"""Shared pieces of the training-data operators: shared folder, tables, small column expressions.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import contextlib
import sys
import types
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import hadoop_path, scratch_path

# Functions of this subpackage travel to the Python workers by value, so that executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Bytes of an Arrow batch that goes to a Python worker; a task holds a few at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that long texts don't add up in the Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


#: Rows that the Parquet reader decodes at a time where texts are read; it holds their texts in one array.
READ_ROWS = 256


def small_reads(spark: SparkSession) -> SparkSession:
    """small_batches, and texts decoded from Parquet READ_ROWS at a time (4,096 by default), so that they don't add up in the JVM."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))
    return small_batches(spark)


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most `most` bytes for what is computed inside; afterwards as they were."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = str(spark.conf.get(key, "67108864b"))
    spark.conf.set(key, str(min(most, int(before.rstrip("b")))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Paths that this process has made in the shared folder and not deleted yet, in order.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir; a temporary folder only on a local master); it goes when the
    application ends, at the latest."""
    MADE.append(scratch_path(spark, name))
    return MADE[-1]


def drop_scratch(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete what was made in the shared folder after the first `since` paths; results that still read it must be written first."""
    for path in [p for p in MADE[since:] if p != keep]:
        fs, at = hadoop_path(spark, path)
        fs.delete(at, True)
        MADE.remove(path)


#: Narrow rows (some numbers each) that make a file, where a table's number of rows is known beforehand.
FILE_ROWS = 100_000


def materialise(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.
    rows: how many narrow rows it has at most, about; a small table is then written by few tasks as few files."""
    spark = small_batches(df.sparkSession)
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with what it has freed given back to the system at its end: Spark keeps the worker for later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker process; functions pickled by value lose their module globals between tasks."""
    store = sys.modules.setdefault("_lexloom_worker_state", types.ModuleType("_lexloom_worker_state"))
    return store.__dict__.setdefault(name, {})


#: A key with at least this share of the rows is hot; there are fewer such keys than one by this share.
HOT = 1e-3
#: Rows of narrow keys that may travel to every task.
SMALL_ROWS = 200_000


def join_hot(rows: DataFrame, table: DataFrame, keys: str | list[str], weight: str, total: int) -> DataFrame:
    """rows joined to a table of distinct keys (not null) by these. weight: the table's column that says how many rows have
    the key; total: their sum. Keys with a share of HOT (at most 1 / HOT of them) are broadcast, all others are shuffled."""
    keys = [keys] if isinstance(keys, str) else keys
    is_hot = F.col(weight) > int(HOT * total)
    hot = table.where(is_hot)
    common = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(~is_hot), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(common)


def if_small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table of narrow rows, to be broadcast if it has at most `most` rows, else to be joined by a shuffle."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def text_of(col: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def id_remainder(col: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % by


def sql_string(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
