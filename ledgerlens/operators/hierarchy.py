"""Functional dependencies between the columns of a table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import is_measure, is_scalar
from .cells import bounded

CELLS = 2_000_000
SCHEMA = "applicable boolean, reason string, rows bigint, seq bigint, from_col string, to_col string, distinct_from bigint, distinct_to bigint, pair_groups bigint, g3 double, g3_reverse double, gk_lambda double, rows_per_value double"
EDGE, ALIAS = 0.05, 0.01


def hierarchy_candidates(df: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """One row per ordered pair of dimension-like columns: how nearly the first determines the second.

    g3 is the share of rows that break it, gk_lambda Goodman and Kruskal's lambda. Null is a value like others. The
    values of a row's column pairs are exploded as 64-bit hashes of one array, so that all pairs share one shuffle of
    (pair, value, value) counts; both directions are read off those.
    """
    spark = df.sparkSession
    fields = [f.name for f in df.schema.fields if is_scalar(f.dataType)]
    candidates = [f.name for f in df.schema.fields if is_scalar(f.dataType) and not is_measure(f.dataType)]
    read = bounded(df, cells, len(fields)) if fields else df
    refuse = lambda why: spark.createDataFrame([(False, why, *[None] * 11)], SCHEMA)
    if not fields:
        return refuse("empty table")
    # distinct values and filled rows of every column, in one pass combined before the shuffle
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(candidates)] or [F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("v"))])
    per = read.select(F.explode(each).alias("c")).select("c.*").groupBy("i", "v").agg(F.count("*").alias("n"))
    stats = {r.i: r for r in per.groupBy("i").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct"), F.count("*").alias("groups"), F.max("n").alias("modal")).collect()}
    rows = max((r.total for r in stats.values()), default=0)
    if not rows:
        return refuse("empty table")
    pool = [i for i in range(len(candidates)) if i in stats and stats[i].groups >= 2 and not (stats[i].filled > 0 and stats[i].distinct == stats[i].filled)]
    if len(pool) < 2:
        return refuse("fewer than two dimension-like columns")
    value = lambda i: F.xxhash64(F.col(f"`{candidates[i]}`").cast("string"), F.col(f"`{candidates[i]}`").isNull())
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a).alias("x"), value(b).alias("y")) for a, b in combinations(pool, 2)])
    counts = read.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    sides = counts.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("x").alias("v"), "n"), F.struct(F.lit(1).alias("d"), F.col("y").alias("v"), "n"))).alias("s")).select("a", "b", "s.*")
    best = sides.groupBy("a", "b", "d", "v").agg(F.max("n").alias("most"), F.count("*").alias("g")).groupBy("a", "b", "d").agg(F.sum("most").alias("agree"), F.sum("g").alias("groups")).collect()
    agree = {(r.a, r.b) if r.d == 0 else (r.b, r.a): (r.agree, r.groups) for r in best}
    out = []
    for a, b in combinations(pool, 2):
        for f, t in ((a, b), (b, a)):
            good, groups = agree[f, t]
            modal = stats[t].modal
            lam = 0.0 if rows == modal else (good - modal) / (rows - modal)
            out.append((True, None, rows, len(out) + 1, candidates[f], candidates[t], stats[f].groups, stats[t].groups, groups, (rows - good) / rows, (rows - agree[t, f][0]) / rows, lam, rows / stats[f].groups))
    return spark.createDataFrame(out, SCHEMA)


def detect_hierarchies(candidates: DataFrame) -> DataFrame:
    """The pairs that hold on all but a twentieth of the rows; an alias holds both ways on all but a hundredth."""
    kind = F.when((F.col("g3") <= ALIAS) & (F.col("g3_reverse") <= ALIAS), "alias").otherwise("edge")
    return candidates.filter(F.col("applicable") & (F.col("g3") <= EDGE)).withColumn("kind", kind)


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with the closest dependency first."""
    return candidates.withColumn("place", F.row_number().over(Window.orderBy(F.col("g3").asc_nulls_last(), F.col("gk_lambda").desc_nulls_last(), "seq")))
