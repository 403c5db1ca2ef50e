"""Exact order statistics of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many values the built-in exact aggregate, which holds all distinct ones in one task, is used.
IN_MEMORY = 2_000_000
BINS = 4096


def _bucket(a: float, b: float) -> Column:
    """The bin of ``x`` in the range from ``a`` to ``b``: one of BINS, or of two where no width can be told."""
    x, width = F.col("x"), (b - a) / BINS
    if math.isinf(a) or math.isinf(b):
        return ((x > F.lit(a)) if math.isinf(a) else (x == F.lit(b))).cast("long")
    if width > 0 and math.isfinite(width):
        return F.least(F.floor((x - a) / width), F.lit(BINS - 1))
    return (x > (a / 2 + b / 2)).cast("long")


def at_rank(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values at 0-based ``ranks`` of the double column ``x`` (no nulls).

    Nested histograms: the range that holds a rank is cut into BINS of equal width and only the bin that holds it is
    looked at again, until its least and greatest value are one. All ranks share their passes. Nothing is sorted; a
    pass shuffles BINS rows a range at most from each task. NaN comes last, as in a sort.
    """
    told = values.filter(~F.isnan("x"))
    n, lo, hi = told.agg(F.count("x"), F.min("x"), F.max("x")).first()
    # of each rank, the range that holds it and the rows below that
    at = {rank: (lo, hi, 0) if rank < n else (math.nan, math.nan, n) for rank in ranks}
    while ranges := sorted({(a, b) for a, b, _ in at.values() if a < b}):
        place, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (a, b) in reversed(list(enumerate(ranges))):  # apart from one another
            inside = F.col("x").between(F.lit(a), F.lit(b))
            place, bucket = F.when(inside, F.lit(i)).otherwise(place), F.when(inside, _bucket(a, b)).otherwise(bucket)
        rows = told.select("x", place.alias("i"), bucket.alias("b")).filter("i IS NOT NULL").groupBy("i", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for rank, (a, b, below) in at.items():
            if not a < b:
                continue
            for r in sorted(r for r in rows if ranges[r.i] == (a, b)):
                if below + r.n > rank:
                    at[rank] = (r.lo, r.hi, below)
                    break
                below += r.n
    return [at[rank][0] for rank in ranks]


def quantiles(df: DataFrame, x: Column, cont: list[float], n: int) -> list[float | None]:
    """Continuous quantiles (linear between neighbours) of the ``n`` non-null values of ``x``."""
    if not n:
        return [None] * len(cont)
    values = df.select(x.cast("double").alias("x")).filter("x IS NOT NULL")
    if n <= IN_MEMORY:
        return list(values.agg(F.percentile("x", F.array(*[F.lit(p) for p in cont]))).first()[0])
    places = [p * (n - 1) for p in cont]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = dict(zip(ranks, at_rank(values, ranks)))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def lower_median(df: DataFrame, x: Column, n: int) -> float | None:
    """The lower of the two middle values: one that the data holds."""
    if not n:
        return None
    values = df.select(x.cast("double").alias("x")).filter("x IS NOT NULL")
    if n <= IN_MEMORY:
        return values.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)")).first()[0]
    return at_rank(values, [(n - 1) // 2])[0]
