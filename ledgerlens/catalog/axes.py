"""The cells of a column's additivity: time axes, alignments of entities, and what both sides hold at the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, is_integer, is_numeric, is_temporal
from .subjects import parse_side, split

SCHEMA = "side string, event string, align string, measure_align string, axis string, term string, identifier boolean, entity string, period timestamp, value double, reason string"
KEY_SHARE, LEAST_DAYS = 0.9, 4


def _edges(ws, ds: str) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """(child, keys, parent, keys) of the declared relationships within a dataset."""
    out = []
    for r in ws.store.current("relationships", dataset=ds):
        (_, lt, lk), (_, rt, rk) = parse_side(r["left_side"]), parse_side(r["right_side"])
        out.append((lt, tuple(lk), rt, tuple(rk)))
    return out


def _entity(keys: tuple[str, ...], prefix: str = "") -> "F.Column":
    cols = [F.col(f"{prefix}`{k}`").cast("string") for k in keys]
    return cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)


def _filled(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(f"`{k}`").isNotNull())
    return df


def _dated(ws, ds: str, table: str, edges) -> list[tuple[str, DataFrame, str]]:
    """(axis label, the table with that date, its column): own dates, else those one edge away."""
    df = ws.relation(ds, table)
    own = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    if own:
        return [(c, df, c) for c in own]
    out = []
    for child, ck, parent, pk in edges:
        if child != table or parent == table:
            continue
        other = ws.relation(ds, parent)
        dates = [f.name for f in other.schema.fields if is_temporal(f.dataType)]
        for d in dates:
            slim = _filled(other, pk).select(*[F.col(f"`{k}`").cast("string").alias(f"_p{i}") for i, k in enumerate(pk)], F.col(f"`{d}`").alias("_date"))
            cond = [F.col(f"`{k}`").cast("string") == F.col(f"_p{i}") for i, k in enumerate(ck)]
            out.append((f"{parent}.{d}", df.join(slim, cond), "_date"))
    return out


def additivity_cells(ws, ds: str, table: str, column: str) -> DataFrame:
    """Both sides of a column's evidence, or the reason that refuses it.

    Alignments: a declared edge between the two tables, or two edges that meet at one key of a third table. The event
    side is summed only for entities that have LEAST_DAYS days on the measure side, which a semi-join sees to.
    """
    spark = ws.spark
    refuse = lambda why: spark.createDataFrame([("reason", *[None] * 9, why)], SCHEMA)
    df = ws.relation(ds, table)
    kind = df.schema[column].dataType
    edges = _edges(ws, ds)
    keys = {k for c, ck, p, pk in edges for t, ks in ((c, ck), (p, pk)) if t == table for k in ks}
    if not is_numeric(kind):
        return refuse(f"{column} is not numeric")
    if column in keys:
        return refuse(f"{column} is a key of a declared relationship")
    if is_integer(kind):
        filled, distinct = df.agg(F.count(f"`{column}`"), F.approx_count_distinct(f"`{column}`")).first()
        if distinct >= 2 and distinct >= KEY_SHARE * filled:
            return refuse(f"{column} is shaped like a key")
    axes = _dated(ws, ds, table, edges)
    if not axes:
        return refuse(f"{table} has no time axis")
    aligned = []  # (event table, align label, measure keys, event keys)
    for c, ck, p, pk in edges:
        if c == table and p != table:
            aligned.append((p, f"{table}.{'|'.join(ck)}", ck, pk))
        if p == table and c != table:
            aligned.append((c, f"{table}.{'|'.join(pk)}", pk, ck))
    for c1, k1, p1, q1 in edges:
        for c2, k2, p2, q2 in edges:
            if c1 == table and c2 != table and (p1, q1) == (p2, q2):
                aligned.append((c2, f"{p1}.{'|'.join(q1)}", k1, k2))
    aligned = sorted({a for a in aligned if any(is_temporal(f.dataType) for f in ws.relation(ds, a[0]).schema.fields) or _dated(ws, ds, a[0], edges)})
    if not aligned:
        return refuse(f"{table} has no declared edge to an event table")
    roles = ws.claims(ds, "role")
    parts = []

    def piece(rows: DataFrame, **fixed) -> None:
        names = [p.split(" ") for p in SCHEMA.split(", ")]
        parts.append(rows.select(*[(F.lit(fixed[n]).cast(t) if n in fixed else F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in names]))

    measure_keys = {}
    for event, label, mk, ek in aligned:
        measure_keys.setdefault("|".join(mk), mk)
    sums: dict[tuple[str, str], DataFrame] = {}
    for axis, dated, date in axes:
        for name, mk in measure_keys.items():
            day = F.date_trunc("day", F.col(f"`{date}`").cast("timestamp"))
            s = _filled(dated, mk).filter(F.col(f"`{date}`").isNotNull() & F.col(f"`{column}`").isNotNull()).groupBy(_entity(mk).alias("entity"), day.alias("period")).agg(F.sum(as_double(F.col(f"`{column}`"), kind)).alias("value"))
            sums[axis, name] = s
            piece(s, side="measure", align=name, axis=axis)
    one = spark.range(1)
    for event, label, mk, ek in aligned:
        e = ws.relation(ds, event)
        ekeys = {k for c, ck, p, pk in edges for t, ks in ((c, ck), (p, pk)) if t == event for k in ks}
        terms = [f for f in e.schema.fields if is_numeric(f.dataType) and f.name not in ekeys and roles.get(f"{ds}.{event}.{f.name}", {}).get("value") == "measure"]
        name = "|".join(mk)
        for eaxis, dated, date in _dated(ws, ds, event, edges):
            if not terms:
                for axis, _, _ in axes:
                    piece(one, side="unglossed", event=event, align=label, measure_align=name, axis=eaxis, term=axis, reason=f"no measure is glossed on {event}: gloss role on its columns")
                continue
            piece(one, side="alignment", event=event, align=label, measure_align=name, axis=eaxis)
            viable = None
            for axis, _, _ in axes:
                v = sums[axis, name].groupBy("entity").agg(F.count("*").alias("days")).filter(F.col("days") >= LEAST_DAYS).select("entity")
                viable = v if viable is None else viable.unionByName(v)
            day = F.date_trunc("day", F.col(f"`{date}`").cast("timestamp"))
            rows = _filled(dated, ek).filter(F.col(f"`{date}`").isNotNull()).withColumn("entity", _entity(ek)).join(viable, "entity", "left_semi")
            got = rows.groupBy("entity", day.alias("period")).agg(*[F.sum(as_double(F.col(f"`{t.name}`"), t.dataType)).alias(f"_t{i}") for i, t in enumerate(terms)])
            each = F.array(*[F.struct(F.lit(t.name).alias("term"), F.col(f"_t{i}").alias("value")) for i, t in enumerate(terms)])
            piece(got.select("entity", "period", F.explode(each).alias("x")).select("entity", "period", "x.term", "x.value").filter("value IS NOT NULL"), side="event", event=event, align=label, axis=eaxis)
        numeric = [f.name for f in e.schema.fields if is_numeric(f.dataType) and is_integer(f.dataType)]
        if numeric:
            shares = e.agg(*[(F.approx_count_distinct(f"`{c}`") / F.greatest(F.count(f"`{c}`"), F.lit(1))).alias(c) for c in numeric])
            each = F.array(*[F.struct(F.lit(c).alias("term"), F.lit(c in ekeys).alias("identifier"), F.col(f"`{c}`").alias("value")) for c in numeric])
            piece(shares.select(F.explode(each).alias("x")).select("x.*"), side="column", event=event)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["side", "event", "align", "measure_align", "axis", "term", "entity", "period"]).cache()
