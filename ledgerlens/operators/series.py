"""Metric series by period, instant and dimension, and definitions that turn out to be the same series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import type_name

SCHEMA = "view string, dimension string, member string, period timestamp, instant timestamp, value double, num double, den double, weight double, rows bigint"


@dataclass(frozen=True)
class Axes:
    """How a view is read: its period and value columns, the grain, and what it is broken down by."""

    view: str
    period: str
    value: str
    at_grain: str | None
    by_instant: bool = False
    num: str | None = None
    den: str | None = None
    dimensions: tuple[str, ...] = ()


def series_aggregate(spark: SparkSession, views: dict[str, DataFrame], axes: list[Axes]) -> DataFrame:
    """Per view the total (dimension and member empty, no weight) and one series a dimension, in one pass over the view.

    Each row is exploded to the total and its dimensions before a two-step aggregate, so the shuffle carries sums.
    Views that aren't there or lack the period or value column are skipped, absent num and den columns read null,
    and axes without a grain aren't read.
    """
    out = None
    for a in axes:
        df = views.get(a.view)
        if df is None or a.at_grain is None or a.period not in df.columns or a.value not in df.columns:
            continue
        number = lambda c: F.col(f"`{c}`").cast("double") if c and c in df.columns else F.lit(None).cast("double")
        own = F.col(f"`{a.period}`").cast("timestamp")
        dims = [d for d in a.dimensions if d in df.columns]
        total = F.struct(F.lit("").alias("dimension"), F.lit("").alias("member"))
        each = F.array(total, *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("NULL")).alias("member")) for d in dims])
        rows = df.select(F.date_trunc(a.at_grain, own).alias("period"), (own if a.by_instant else F.lit(None).cast("timestamp")).alias("instant"), number(a.value).alias("v"), number(a.num).alias("n"), number(a.den).alias("d"), F.explode(each).alias("m"))
        part = rows.groupBy("m.dimension", "m.member", "period", "instant").agg(F.sum("v").alias("value"), F.sum("n").alias("num"), F.sum("d").alias("den"), F.sum(F.when(F.col("m.dimension") != "", F.abs("v"))).alias("weight"), F.count("*").alias("rows"))
        part = part.select(F.lit(a.view).alias("view"), "dimension", "member", "period", "instant", "value", "num", "den", "weight", "rows")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def folded(df: DataFrame, period: str, value: str, grain: str = "month", additivity: str = "additive", num: str | None = None, den: str | None = None) -> DataFrame:
    """(period, value, has_null): a flow summed, a stock its last level, a ratio its summed halves divided."""
    t, v = F.col(f"`{period}`").cast("timestamp"), F.col(f"`{value}`").cast("double")
    if additivity == "semi-additive":
        fold = F.max_by(v, t)
    elif additivity == "ratio":
        fold = F.try_divide(F.sum(F.col(f"`{num}`").cast("double")), F.sum(F.col(f"`{den}`").cast("double")))
    else:
        fold = F.sum(v)
    return df.filter(t.isNotNull()).groupBy(F.date_trunc(grain, t).alias("period")).agg(fold.alias("value"), F.bool_or(v.isNull()).alias("has_null"))


def fingerprint(df: DataFrame, **how) -> DataFrame:
    """(fingerprint, months): the monthly values as one text; none if a month has no value or a null was read."""
    f = folded(df, **how)
    text = F.concat(F.date_format("period", "yyyy-MM"), F.lit("="), F.format_string("%.2f", F.round("value", 2)))
    told = f.agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("fingerprint"), F.count("*").alias("months"), F.coalesce(F.bool_or(F.col("has_null") | F.col("value").isNull()), F.lit(True)).alias("broken"))
    return told.filter(~F.col("broken")).select("fingerprint", "months")


COLLISION_SCHEMA = "definitions bigint, seq bigint, kind string, sql string, months bigint, properties array<string>, subjects array<string>"


def definition_collisions(spark: SparkSession, definitions: list[dict], views: dict[str, DataFrame]) -> DataFrame:
    """Definitions {property, subject, flavor, sql[, period, value, additivity, num, den]} that are one thing twice.

    Of one flavor: the same statement once parsed (case and spacing aside) under different properties, or, where the
    statements differ, the same value in every month. None is one row with the number of definitions.
    """
    canon = {d["property"]: canonical(spark, d["sql"]) for d in definitions}
    groups: dict[tuple, list[dict]] = {}
    for d in definitions:
        groups.setdefault((d.get("flavor") or "", canon[d["property"]]), []).append(d)
    n = len(definitions)
    hits = [("sql", min(d["sql"] for d in g), None, g) for g in groups.values() if len({d["property"] for d in g}) > 1]
    prints: dict[tuple, list[tuple]] = {}
    for d in definitions:
        df = views.get(d["property"])
        if df is None:
            continue
        period = d.get("period") or next((c for c in df.columns if c == "period"), None) or next((f.name for f in df.schema.fields if type_name(f.dataType).startswith(("DATE", "TIMESTAMP"))), None)
        value = d.get("value") or next((c for c in df.columns if c == "value"), None)
        if not period or not value:
            continue
        got = fingerprint(df, period=period, value=value, additivity=d.get("additivity") or "additive", num=d.get("num"), den=d.get("den")).first()
        if got and got.months:
            prints.setdefault((d.get("flavor") or "", got.fingerprint), []).append((d, got.months))
    hits += [("served_series", "", max(m for _, m in g), [d for d, _ in g]) for g in prints.values() if len({d["property"] for d, _ in g}) > 1 and len({canon[d["property"]] for d, _ in g}) > 1]
    told = [(k, sql, months, sorted({d["property"] for d in g}), sorted({d["subject"] for d in g})) for k, sql, months, g in hits]
    told.sort(key=lambda r: (r[0] != "sql", r[3]))
    return spark.createDataFrame([(n, i, *r) for i, r in enumerate(told, 1)] or [(n, *[None] * 6)], COLLISION_SCHEMA)


def canonical(spark: SparkSession, sql: str) -> str:
    """The statement's parsed plan in lower case; its words where it doesn't parse."""
    import re

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
        return re.sub(r"#\d+L?", "", plan).lower()
    except Exception:  # not this dialect
        return " ".join(sql.split()).lower()
