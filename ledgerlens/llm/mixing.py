"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket; the bucket in which a source's budget ends is found from the running
sum of that histogram and only that bucket is split again, BITS bits at a time, until the hash is used up. A
document is taken if its hash lies below the threshold of its source, so nothing is sorted and reruns agree.
Budgets above a source's size are nested: whole passes over the source, then a threshold for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged

#: Bits of the hash, and how many of them each histogram resolves.
HASH_BITS, BITS = 60, 12
#: No source is taken more often than this.
CAP = 3
#: A table of sources up to this many rows is broadcast (a row holds a name and a few numbers).
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of runs of non-space characters (space: ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights 1, 2, 3 by code point, capped at CAP sizes.

    The excess of a capped source goes to the others by weight: with sources in order of CAP * size / weight, the
    capped ones come first, and the level is what is left divided by the weight that is left. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("long"))
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy((CAP * F.col("source_size")).cast("double") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(CAP * F.col("source_size")).over(by_cap), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0))
    level = w.withColumn("level", left.cast("double") / heavy)
    least = level.withColumn("fits", F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    final = least.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    return final.select("source", "source_size", F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def _near(lookup: DataFrame, n: int) -> DataFrame:
    return F.broadcast(lookup) if n <= BROADCAST_SOURCES else lookup


def _hash(id_col: str, text_col: str) -> Column:
    """HASH_BITS bits of the id (of the text, where that is null): rows that repeat it are taken or left together."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":mix"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def limits(sized: DataFrame) -> tuple[DataFrame, int]:
    """Of (source, size, h): one row a source (s, source_size, target, passes, limit, nearer), and their number.

    passes: how often all of the source is taken; limit: the hash below which a document is taken once more; nearer:
    whether the documents of just that hash are, too, which brings the source closer to its budget.
    """
    sums = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n = sums.count()
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("long")
    state = sums.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    at = state.filter("source_size > 0").select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        met = sized.join(_near(at.select("s", "budget", "prefix", "before"), n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        hist = met.groupBy("s", "budget", "before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("within"))
        run = F.sum("within").over(Window.partitionBy("s", "budget", "before").orderBy("bucket"))
        ends = hist.withColumn("upto", F.col("before") + run)
        # the bucket in which the budget ends: begins at or below it, ends above it
        ends = ends.filter((F.col("upto") - F.col("within") <= F.col("budget")) & (F.col("upto") > F.col("budget")))
        at = staged(ends.select("s", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("within")).alias("before"), "within"), f"bucket{shift}")
    # a source whose budget is never passed (none left over) has no row: nothing beyond its passes is taken
    ended = at.select("s", F.col("prefix").alias("limit"), (2 * F.col("before") + F.col("within") <= 2 * F.col("budget")).alias("nearer"))
    return state.join(ended, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "passes", "limit", "nearer"), n


def _times(h: Column) -> Column:
    extra = F.when((h < F.col("limit")) | ((h == F.col("limit")) & F.col("nearer")), 1).otherwise(0)
    return (F.col("passes") + extra).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words that the mix takes of it), times.

    Null text has size 0; a null source is a source of its own, last in order. Rows that repeat an id are taken or left
    together. Of the document at which a budget ends the side nearer to the budget is taken, ties taken. A source
    without words has target and taken 0. Other columns are not looked at; an empty table gives no rows.
    """
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")), "sized")
    known, n = limits(sized)
    met = sized.join(_near(known, n), F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(F.col("h")))
    return met.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def blend(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    sized = staged(docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")), "sized")
    known, n = limits(sized)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(source_col).alias("_source"), _hash(id_col, text_col).alias("_h"))
    met = own.join(_near(known, n), F.col("_source").eqNullSafe(F.col("s"))).withColumn("_times", _times(F.col("_h")))
    return met.filter("_times > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':mix'), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(max(level) FILTER (WHERE level * weight <= 3 * source_size) OVER () * weight, CAST('inf' AS DOUBLE))) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS passes FROM t
), c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN upto - own <= budget AND 2 * (upto - own) + own <= 2 * budget THEN passes + 1 ELSE passes END * size AS BIGINT) AS taken
FROM c
"""
