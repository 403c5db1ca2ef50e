"""Profiles of columns: counts and range, outliers, cadence of a time column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import lower_median, quantiles
from ..functions.types import INTEGERS, is_scalar, is_temporal, type_name


def _scalars(df: DataFrame, columns: list[str] | None) -> list[str]:
    return [f.name for f in df.schema.fields if is_scalar(f.dataType) and (columns is None or f.name in columns)]


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, total, null_ratio, distinct, min, max) of each scalar column.

    Counts and range of all columns come from one pass without a shuffle; distinct values from one two-step
    aggregate over (column, value), combined before the shuffle, so no column needs a pass of its own.
    """
    names = _scalars(df, columns)
    spark = df.sparkSession
    schema = "column string, total bigint, null_ratio double, distinct bigint, min string, max string"
    if not names:
        return spark.createDataFrame([], schema)
    c = lambda i: F.col(f"`{names[i]}`")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[f(c(i)).alias(f"{k}{i}") for i in range(len(names)) for k, f in (("f", F.count), ("a", F.min), ("z", F.max))])
    told = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("n").alias("total"), F.col(f"f{i}").alias("filled"), F.col(f"a{i}").cast("string").alias("min"), F.col(f"z{i}").cast("string").alias("max")) for i in range(len(names))])).alias("r")).select("r.*")
    # zero has one text
    text = lambda i: (c(i) + F.lit(0.0)).cast("string") if isinstance(df.schema[names[i]].dataType, (T.FloatType, T.DoubleType)) else c(i).cast("string")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(i).alias("v")) for i in range(len(names))])).alias("r")).select("r.*").filter("v IS NOT NULL")
    distinct = cells.groupBy("i", "v").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("distinct"))
    ratio = F.when(F.col("total") == 0, 0.0).otherwise((F.col("total") - F.col("filled")) / F.greatest(F.col("total"), F.lit(1)))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1)
    return told.join(F.broadcast(distinct), "i", "left").select(label.alias("column"), "total", ratio.cast("double").alias("null_ratio"), F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), "min", "max")


def outlier_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: applicable, parsed, lower, upper, iqr_count, iqr_ratio, z_count, z_ratio.

    Fences at 1.5 interquartile ranges; modified z-scores over 3.5 by the median absolute deviation, none where that is
    zero. A column of which nothing parses as a number isn't applicable.
    """
    # numbers that are their text's double already aren't spelt out
    own = isinstance(df.schema[column].dataType, (*INTEGERS, T.DoubleType))
    x = F.col(f"`{column}`").cast("double") if own else F.expr(f"try_cast(CAST(`{column}` AS STRING) AS DOUBLE)")
    values = df.select(x.alias("x")).filter("x IS NOT NULL")
    n = values.count()
    q1, med, q3 = quantiles(values, F.col("x"), [0.25, 0.5, 0.75], n)
    lower, upper = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if n else (None, None)
    (mad,) = quantiles(values, F.abs(F.col("x") - F.lit(med)), [0.5], n) if n else (None,)
    out = values.agg(
        F.coalesce(F.sum(((F.col("x") < F.lit(lower)) | (F.col("x") > F.lit(upper))).cast("long")), F.lit(0)).alias("iqr_count"),
        F.coalesce(F.sum((F.abs(0.6745 * (F.col("x") - F.lit(med)) / F.lit(mad)) > 3.5).cast("long")), F.lit(0)).alias("z_count") if mad else F.lit(0).cast("long").alias("z_count"),
    )
    share = lambda c: (F.col(c) / n).cast("double") if n else F.lit(None).cast("double")
    told = lambda c: F.col(c) if n else F.lit(None).cast("long")
    return out.select(F.lit(n > 0).alias("applicable"), F.lit(n).cast("long").alias("parsed"), F.lit(lower).cast("double").alias("lower"), F.lit(upper).cast("double").alias("upper"), told("iqr_count").alias("iqr_count"), share("iqr_count").alias("iqr_ratio"), told("z_count").alias("z_count"), share("z_count").alias("z_ratio"))


#: (grain, seconds, tolerance), first match wins.
GRAINS = [("second", 1, 0.5), ("minute", 60, 5), ("hour", 3600, 300), ("day", 86400, 3600), ("week", 604800, 86400), ("month", 2592000, 259200), ("quarter", 7776000, 777600), ("year", 31536000, 3153600)]
#: Slices of the time range in which neighbours are looked for side by side.
SLICES = 4096
TOP_GAPS = 20


def _bucket(grain: str):
    """The calendar bucket of the timestamp ``t`` whose seconds are ``s``."""
    y, m = F.year("t"), F.month("t")
    return {
        "second": F.col("s"), "minute": F.floor(F.col("s") / 60), "hour": F.floor(F.col("s") / 3600), "day": F.floor(F.col("s") / 86400),
        "week": F.floor((F.col("s") + 259200) / 604800), "month": y * 12 + m, "quarter": y * 4 + F.quarter("t"), "year": y,
    }[grain]


def _gaps(ts: DataFrame, lo: float, hi: float) -> DataFrame:
    """(a, b): neighbouring distinct instants. Neighbours within a slice of the range are found in that slice's task;
    those across slices from each slice's first and last instant, of which there are SLICES at most."""
    width = max((hi - lo) / SLICES, 1e-6)
    cut = ts.withColumn("slice", F.floor((F.col("s") - lo) / width))
    inner = cut.select(F.col("s").alias("a"), F.lead("s").over(Window.partitionBy("slice").orderBy("s")).alias("b")).filter("b IS NOT NULL")
    ends = cut.groupBy("slice").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    outer = ends.select(F.col("last").alias("a"), F.lead("first").over(Window.orderBy("slice")).alias("b")).filter("b IS NOT NULL")
    return inner.unionByName(outer).withColumn("gap", F.col("b") - F.col("a"))


def temporal_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: applicable, reason, min, max, span_days, granularity, confidence, gap_count, largest_days, gap_sample,
    expected, actual, ratio. Cadence is the named grain nearest to the lower median gap between distinct instants."""
    spark = df.sparkSession
    kind = df.schema[column].dataType
    schema = "applicable boolean, reason string, min string, max string, span_days double, granularity string, confidence double, gap_count bigint, largest_days double, gap_sample array<struct<start:string,end:string,days:double,missing_periods:bigint,severity:string>>, expected bigint, actual bigint, ratio double"
    refuse = lambda why: spark.createDataFrame([(False, why, *[None] * 11)], schema)
    if not is_temporal(kind):
        return refuse(f"column type is {type_name(kind)}, not DATE/TIMESTAMP: a date loaded as text needs typing in the recipe")
    t = F.col(f"`{column}`")
    s = F.unix_micros(t.cast("timestamp")) / 1e6
    ts = df.select(t.cast("timestamp").alias("t"), s.alias("s")).filter("s IS NOT NULL").distinct()
    lo, hi, first, last = df.agg(F.min(s), F.max(s), F.min(t).cast("string"), F.max(t).cast("string")).first()
    if lo is None:
        return refuse("no non-null values: nothing bounds a window")
    gaps = _gaps(ts, lo, hi)
    n, least, most = gaps.agg(F.count("*"), F.min("gap"), F.max("gap")).first()
    med = lower_median(gaps, F.col("gap"), n)
    grain = "unknown" if med is None else next((g for g, sec, tol in GRAINS if abs(med - sec) < tol), "irregular")
    confidence = 0.0 if med is None else 0.3 if grain == "irregular" else 1 - min((most - least) / med / 10, 0.5) if least > 0 and med > 0 else 0.7
    wide = gaps.filter(F.col("gap") > F.lit(2 * med)) if med else gaps.limit(0)
    n_wide, largest = wide.agg(F.count("*"), F.max("gap")).first()
    instant = lambda x: F.date_format(F.timestamp_micros((x * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss")
    top = wide.orderBy(F.col("gap").desc(), "a").limit(TOP_GAPS).select(instant(F.col("a")), instant(F.col("b")), F.col("gap")).collect()
    sample = [(a, b, g / 86400, int(g // med) - 1, "severe" if g > 10 * med else "moderate" if g > 5 * med else "minor") for a, b, g in top]
    expected = actual = None
    if grain in dict((g, 0) for g, _, _ in GRAINS):
        actual, e0, e1 = ts.agg(F.countDistinct(_bucket(grain)), F.min(_bucket(grain)), F.max(_bucket(grain))).first()
        expected = int(e1 - e0) + 1
    row = (True, None, first, last, (hi - lo) / 86400, grain, float(confidence), n_wide, None if largest is None else largest / 86400, sample, expected, actual, actual / expected if expected else None)
    return spark.createDataFrame([row], schema)
