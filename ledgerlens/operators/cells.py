"""The cells of tables, and listings of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import is_scalar, type_name

CELLS_SCHEMA = "table string, column string, ci bigint, column_type string, rn bigint, val string"


def bounded(df: DataFrame, cells: int | None, width: int) -> DataFrame:
    """Rows kept by their hash so that about ``cells`` cells are read; the same rows every run; all if they fit."""
    if cells is None:
        return df
    if cells <= 0:
        raise ValueError("cells must be positive")
    rows = df.count()
    most = max(1, cells // max(1, width))
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1_000_000)) < int(most * 1_000_000 / rows))


def dataset_cells(spark: SparkSession, tables: dict[str, DataFrame], cells: int | None = None) -> DataFrame:
    """(table, column, ci, column_type, rn, val): one row per row and scalar column, nulls included.

    Columns are numbered over all tables in order of table name; nested columns have no cells and no number; ``rn``
    tells rows of a table apart and nothing else.
    """
    out, ci = None, 0
    for name in sorted(tables):
        df = tables[name]
        fields = [f for f in df.schema.fields if is_scalar(f.dataType)]
        if not fields:
            continue
        read = bounded(df, cells, len(fields)).withColumn("_rn", F.monotonically_increasing_id() + 1)
        each = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(ci + i).cast("long").alias("ci"), F.lit(type_name(f.dataType)).alias("column_type"), F.col(f"`{f.name}`").cast("string").alias("val")) for i, f in enumerate(fields, 1)])
        ci += len(fields)
        part = read.select(F.lit(name).alias("table"), F.explode(each).alias("c"), F.col("_rn").alias("rn")).select("table", "c.column", "c.ci", "c.column_type", "rn", "c.val")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], CELLS_SCHEMA) if out is None else out


def columns(spark: SparkSession, tables: dict[str, DataFrame], views: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table_name, column_name, column_type, ordinal_position, table_type), by relation name and position."""
    rows = [(name, f.name, type_name(f.dataType), i, kind) for kind, group in (("BASE TABLE", tables), ("VIEW", views or {})) for name, df in group.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[3])), "table_name string, column_name string, column_type string, ordinal_position int, table_type string")


def subject_column(df: DataFrame, column: str) -> DataFrame:
    """The column alone, as ``v``."""
    return df.select(F.col(f"`{column}`").alias("v"))
