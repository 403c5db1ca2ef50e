"""What the operators share: the shared folder, staged tables, folds, and joins that stand a hot key."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: At most this many groups are called hot, so that a table of them can be broadcast.
HOT_GROUPS = 200
#: Rows that Spark hands to Python at once, at most: ten times as many long texts don't fit beside the JVM's copies.
ARROW_ROWS = 1000


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="ledgerlens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_dir()).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: later jobs neither recompute it nor lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hands what a Python worker has freed back to the system: workers live on, and an idle one should hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run):
    """``run``, a function of one or two Arrow tables, with what it used handed back when it is done."""
    import inspect

    def done(*tables):
        try:
            return run(*tables)
        finally:
            release()

    # Spark tells by the number of arguments whether a function takes the key
    return (lambda table: done(table)) if len(inspect.signature(run).parameters) == 1 else (lambda left, right: done(left, right))


def map_batches(source: DataFrame, run, schema) -> DataFrame:
    """``source.mapInArrow(run, schema)`` in batches of ARROW_ROWS rows at most (set for the session, if its own are larger)."""
    conf, key = source.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return source.mapInArrow(task, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def hot_join(left: DataFrame, lookup: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Left join of ``left`` to ``lookup`` (one row a ``key``; ``size``: how many rows of ``left`` it meets).

    Keys with more than rows / HOT_GROUPS rows number fewer than HOT_GROUPS, whatever the data: that bounded table
    is broadcast, so no task gathers a hot key. All other keys meet in an ordinary shuffle join.
    """
    least = max(rows // HOT_GROUPS, 1000)
    hot = lookup.filter(F.col(size) > least)
    cold = lookup.filter(F.col(size) <= least)
    names = F.broadcast(hot.select(F.col(key).alias("_hot")))
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(names, F.col(key) == F.col("_hot"), "left_anti").join(cold, key, "left"))


def one_of_each(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Of ``rows`` (row, key), the columns of one row for each key of ``kept`` (distinct): the first by a hash of all.

    The key is one column, a struct (whose null fields equal one another), so that the join and the choice among rows
    that repeat it take the same single exchange of the rows.
    """
    nth = F.row_number().over(Window.partitionBy("_kept").orderBy(F.xxhash64("row")))
    kept = kept.select(F.col("key").alias("_kept"))
    return rows.join(kept, F.col("key") == F.col("_kept")).withColumn("nth", nth).filter("nth = 1").select("row.*")
