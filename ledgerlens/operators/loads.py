"""What a load does to a table: key checks, the keyed merge, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys + rows, of keys that several rows have (null is a key)."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("rows")).filter("rows > 1")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table after a merge by key, one row with updated, inserted and kept).

    Rows of an equal key (null equals null) take the new values if any differs; others stay or are added. Columns are
    the old table's, met by name.
    """
    values = [c for c in old.columns if c not in keys]
    here = old.select(F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("o"), *[F.col(f"`{k}`").alias(f"_o{i}") for i, k in enumerate(keys)])
    there = new.select(F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("n"), *[F.col(f"`{k}`").alias(f"_n{i}") for i, k in enumerate(keys)])
    same_key = reduce(lambda a, b: a & b, [F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(keys))])
    met = here.join(there, same_key, "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in values], F.lit(False))
    state = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(differs, "updated").otherwise("kept")
    marked = met.withColumn("_state", state)
    row = F.when(F.col("_state") == "kept", F.col("o")).otherwise(F.col("n"))
    counts = marked.agg(*[F.count(F.when(F.col("_state") == s, 1)).alias(s) for s in ("updated", "inserted", "kept")])
    return marked.select(row.alias("r")).select("r.*"), counts


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and the sum of row hashes, equal for equal contents in whatever order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))
