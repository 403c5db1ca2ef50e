"""Which numeric column of a table is two others combined."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, is_numeric, is_scalar
from .cells import bounded

CELLS, MOST_COLUMNS, LEAST_FILLED, MAGNITUDE = 2_000_000, 12, 20, 30
ABSOLUTE, RELATIVE = 0.011, 1e-6
SCHEMA = "applicable boolean, reason string, rows bigint, truncated boolean, seq bigint, target string, form string, operand_1 string, operand_2 string, support bigint, violations bigint, match_rate double"


def derivation_candidates(df: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """One row per (target, two operands, product or sum) whose magnitudes fit: rows that support it and that break it.

    All triples are conditional sums of one pass over the typed columns; a pass without a shuffle but for its sums.
    """
    spark = df.sparkSession
    scalars = [f for f in df.schema.fields if is_scalar(f.dataType)]
    numbers = [f for f in scalars if is_numeric(f.dataType)]
    if len(numbers) < 3:
        return spark.createDataFrame([(False, "fewer than three numeric columns", *[None] * 10)], SCHEMA)
    read = bounded(df, cells, len(scalars))
    every = read.agg(*[F.count(f"`{f.name}`").alias(f"f{i}") for i, f in enumerate(numbers)], *[F.avg(F.abs(as_double(F.col(f"`{f.name}`"), f.dataType))).alias(f"m{i}") for i, f in enumerate(numbers[:MOST_COLUMNS])]).first()
    rows = max(every[f"f{i}"] for i in range(len(numbers)))
    if not read.take(1):
        return spark.createDataFrame([(False, "fewer than three numeric columns", *[None] * 10)], SCHEMA)
    used = range(min(len(numbers), MOST_COLUMNS))
    size = {i: every[f"m{i}"] or 0.0 for i in used}
    near = lambda a, b: b < MAGNITUDE * a and a < MAGNITUDE * b
    triples = []
    for a in used:
        for b, c in combinations([i for i in used if i != a], 2):
            if min(every[f"f{i}"] for i in (a, b, c)) < LEAST_FILLED:
                continue
            if size[a] > 0 and size[b] > 0 and size[c] > 0 and near(size[a], size[b] * size[c]):
                triples.append((a, b, c, "product"))
            if size[a] > 0 and size[b] + size[c] > 0 and near(size[a], size[b] + size[c]):
                triples.append((a, b, c, "sum"))
    x = read.select(*[as_double(F.col(f"`{f.name}`"), f.dataType).alias(f"x{i}") for i, f in enumerate(numbers[:MOST_COLUMNS])])
    col = lambda i: F.col(f"x{i}")
    sums = []
    for n, (a, b, c, form) in enumerate(triples):
        value = col(b) * col(c) if form == "product" else col(b) + col(c)
        sums += [F.count(F.when(col(a).isNotNull() & col(b).isNotNull() & col(c).isNotNull(), 1)).alias(f"s{n}"), F.count(F.when(F.abs(col(a) - value) > F.greatest(F.lit(ABSOLUTE), F.abs(col(a)) * RELATIVE), 1)).alias(f"v{n}")]
    got: dict = {}
    for at in range(0, len(sums), 100):  # so many at once that generated code stays small
        got |= x.agg(*sums[at : at + 100]).first().asDict()
    cut = len(numbers) > MOST_COLUMNS
    out = [(True, None, rows, cut, n, numbers[a].name, form, numbers[b].name, numbers[c].name, s := got[f"s{n - 1}"], v := got[f"v{n - 1}"], None if not s else 1 - v / s) for n, (a, b, c, form) in enumerate(triples, 1)]
    return spark.createDataFrame(out or [(True, None, rows, cut, *[None] * 8)], SCHEMA)


def detect_derivations(candidates: DataFrame, rate: float = 0.95, support: int = LEAST_FILLED) -> DataFrame:
    return candidates.filter(F.col("applicable") & (F.col("match_rate") >= rate) & (F.col("support") >= support)).orderBy(F.col("match_rate").desc(), "seq")
