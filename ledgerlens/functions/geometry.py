"""Geometries as well-known binary: kind, validity, extent and area, and a profile of a column of them."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def measure(wkb: bytes | None) -> dict | None:
    """{kind, valid, empty, xmin, ymin, xmax, ymax, area}; kind is null where the bytes are no geometry."""
    if wkb is None:
        return None
    box = [math.inf, math.inf, -math.inf, -math.inf]
    state = {"area": 0.0, "points": 0, "valid": True}
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, wkb, at)
        at += struct.calcsize(fmt)
        return out

    def points(order: str, n: int, dims: int) -> list[tuple[float, float]]:
        out = []
        for _ in range(n):
            p = take(f"{order}{dims}d")
            if math.isnan(p[0]):
                continue
            out.append(p[:2])
            state["points"] += 1
            state["valid"] &= all(map(math.isfinite, p[:2]))
            box[0], box[1], box[2], box[3] = min(box[0], p[0]), min(box[1], p[1]), max(box[2], p[0]), max(box[3], p[1])
        return out

    def read() -> str:
        order = "<" if take("B")[0] else ">"
        (code,) = take(f"{order}I")
        if code & 0x20000000:
            take(f"{order}I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims += (0, 1, 1, 2)[code // 1000]
        kind = KINDS[code % 1000]
        if kind == "POINT":
            points(order, 1, dims)
        elif kind == "LINESTRING":
            state["valid"] &= len(points(order, take(f"{order}I")[0], dims)) != 1
        elif kind == "POLYGON":
            for ring in range(take(f"{order}I")[0]):
                p = points(order, take(f"{order}I")[0], dims)
                state["valid"] &= len(p) >= 4 and p[0] == p[-1]
                twice = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:])))
                state["area"] += (-twice if ring else twice) / 2
        else:
            for _ in range(take(f"{order}I")[0]):
                read()
        return kind

    try:
        kind = read()
    except (struct.error, KeyError, IndexError):
        return {"kind": None, "valid": False, "empty": False, "xmin": None, "ymin": None, "xmax": None, "ymax": None, "area": None}
    empty = not state["points"]
    b = [None] * 4 if empty else box
    return {"kind": kind, "valid": bool(state["valid"]), "empty": empty, "xmin": b[0], "ymin": b[1], "xmax": b[2], "ymax": b[3], "area": state["area"]}


SCHEMA = "kind string, valid boolean, empty boolean, xmin double, ymin double, xmax double, ymax double, area double"


def geometry_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: total, null_ratio, kinds (JSON object of counts), invalid, empty, extent, area_sum, of WKB in a binary column.

    Geometries are measured where they are read, in Arrow batches; only counts and bounds are shuffled.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [measure(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([g or {"kind": "NULL", "valid": None, "empty": None, "xmin": None, "ymin": None, "xmax": None, "ymax": None, "area": None} for g in got], pa.schema([("kind", pa.string()), ("valid", pa.bool_()), ("empty", pa.bool_()), *[(k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax", "area")]]))

    per = df.select(F.col(f"`{column}`").cast("binary").alias("g")).mapInArrow(run, SCHEMA).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum((~F.coalesce("valid", F.lit(True))).cast("long")).alias("invalid"), F.sum(F.coalesce(F.col("empty"), F.lit(False)).cast("long")).alias("empty"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.sum("area").alias("area"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce("kind", F.lit("")) != "NULL", F.struct(F.coalesce("kind", F.lit("UNKNOWN")).alias("k"), F.col("n").alias("v"))))))
    nulls = F.coalesce(F.sum(F.when(F.col("kind") == "NULL", F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(total.alias("total"), F.when(total > 0, nulls / F.greatest(total, F.lit(1))).otherwise(0.0).alias("null_ratio"), F.to_json(kinds).alias("kinds"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"), F.struct(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")).alias("extent"), F.sum("area").alias("area_sum"))
