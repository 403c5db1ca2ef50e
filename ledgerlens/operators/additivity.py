"""Whether a numeric column behaves as a stock or as a flow, by what an event table says moved.

A movement summed per entity and period is held against the column: a flow equals it, a stock changes by it. The
evidence is one row per anchor: an event table, an alignment of entities, a time axis on either side, a grain and a
scope. Cells are a table of entity, period and value of either side at the day; everything after them is a few
grouped aggregates and one window per entity, keyed by anchor and entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PERIODS, LEAST_VOTERS, LEAST_AGREEMENT, BEST_RESIDUAL, MARGIN, MOST_PAIRED_TERMS, DECISIVE = 4, 2, 0.8, 0.05, 1 / 3, 8, 10.0
STOCK, FLOW = "semi-additive", "additive"
ANCHOR_SCHEMA = "applicable boolean, reason string, seq bigint, event string, align string, measure_time string, event_time string, grain string, scope string, entities bigint, viable_entities bigint, identifier_columns array<string>, result string, convention string, voted bigint, agreement double, support double, r_flow double, r_stock double, sign_primary bigint, sign_mirror bigint, sign_both bigint, alternatives array<struct<convention:string,result:string,voted:bigint,support:double>>"


def wilson_lower(s: Column, n: Column) -> Column:
    """Wilson's lower bound at 95% on s successes of n."""
    m = F.greatest(n.cast("double"), F.lit(1.0))
    share = s / m
    bound = (share + 1.9208 / m - 1.96 * F.sqrt(share * (1 - share) / m + 0.9604 / (m * m))) / (1 + 3.8416 / m)
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), bound))


def additivity_vote(n: Column, flat: Column, moving: Column, nan: Column, rf: Column, rs: Column) -> Column:
    """One entity's vote from its residuals as flow and as stock; null abstains."""
    inf = F.lit(float("inf"))
    low, high = F.least(rf, rs), F.greatest(rf, rs)
    margin = F.when(low == inf, 0.0).when(high == inf, 1.0).when(rf + rs == 0, 0.0).otherwise((high - low) / (rf + rs))
    silent = (n < LEAST_PERIODS) | flat | ~moving | nan | (low > BEST_RESIDUAL) | (margin < MARGIN)
    return F.when(silent, F.lit(None).cast("string")).when(rs < rf, STOCK).otherwise(FLOW)


def native_grain(period: Column) -> Column:
    """The coarsest of year, quarter and month to which all periods of a group are truncated, else day (an aggregate)."""
    all_at = lambda g: F.bool_and(period == F.date_trunc(g, period))
    return F.when(all_at("year"), "year").when(all_at("quarter"), "quarter").when(all_at("month"), "month").otherwise("day")


def _coarser(a: Column, b: Column) -> Column:
    return F.when((a == "year") | (b == "year"), "year").when((a == "quarter") | (b == "quarter"), "quarter").when((a == "month") | (b == "month"), "month").otherwise("day")


def _trunc(grain: Column, period: Column) -> Column:
    return F.when(grain == "year", F.date_trunc("year", period)).when(grain == "quarter", F.date_trunc("quarter", period)).when(grain == "month", F.date_trunc("month", period)).otherwise(F.date_trunc("day", period))


def _scoped(entity: Column, scope: Column, period: Column) -> Column:
    return F.when(scope == "year", F.concat(entity, F.lit("@"), F.year(period).cast("string"))).otherwise(entity)


def votes(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (n, r_flow, r_stock, vote, mirror) of series keys + (b, y, m): each entity's residuals and votes."""
    w = Window.partitionBy(*keys).orderBy("b")
    s = series.withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("later", F.row_number().over(w) > 1)
    later = lambda c: F.sum(F.when(F.col("later"), c))
    per = s.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.min("y") == F.max("y")).alias("flat"), F.bool_or(F.col("m") != 0).alias("moving"), F.bool_or(F.isnan("y") | F.isnan("m")).alias("nan"),
        F.sum(F.abs(F.col("y") - F.col("m"))).alias("nf"), F.sum(F.abs("m")).alias("df"), later(F.abs(F.col("dy") - F.col("m"))).alias("ns"), later(F.abs("m")).alias("ds"),
        F.sum(F.abs(F.col("y") + F.col("m"))).alias("nf_neg"), later(F.abs(F.col("dy") + F.col("m"))).alias("ns_neg"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(float("inf")))
    told = per.withColumns({"r_flow": over("nf", "df"), "r_stock": over("ns", "ds"), "_f": over("nf_neg", "df"), "_s": over("ns_neg", "ds")})
    vote = lambda f, s: additivity_vote(F.col("n"), F.col("flat"), F.col("moving"), F.col("nan"), F.col(f), F.col(s))
    return told.withColumns({"vote": vote("r_flow", "r_stock"), "mirror": vote("_f", "_s")}).select(*keys, "n", "r_flow", "r_stock", "vote", "mirror")


def additivity_anchors(cells: DataFrame) -> DataFrame:
    """The anchors of a column's cells.

    cells: (side, event, align, measure_align, axis, term, identifier, entity, period, value, reason), side being
    measure, event, alignment, column, unglossed or reason. A reason refuses the column.
    """
    spark = cells.sparkSession
    refused = cells.filter("side = 'reason'").agg(F.min("reason")).first()[0]
    refuse = lambda why: spark.createDataFrame([(False, why, *[None] * 21)], ANCHOR_SCHEMA)
    if refused:
        return refuse(refused)
    native = cells.filter("side IN ('measure', 'event')").groupBy("side", "event", "align", "axis").agg(native_grain(F.col("period")).alias("native"))
    ids = cells.filter("side = 'column'").groupBy("event").agg(F.array_sort(F.collect_list(F.when(F.col("identifier") | (F.col("value") >= 0.9), F.col("term")))).alias("identifier_columns"))
    ev = cells.filter("side = 'alignment'").select("event", "align", "measure_align", F.col("axis").alias("event_time"))
    ma = native.filter("side = 'measure'").select(F.col("align").alias("measure_align"), F.col("axis").alias("measure_time"), F.col("native").alias("m_native"))
    ea = native.filter("side = 'event'").select("event", "align", F.col("axis").alias("event_time"), F.col("native").alias("e_native"))
    coords = ev.join(ma, "measure_align").join(ea, ["event", "align", "event_time"], "left").withColumn("native", _coarser(F.col("m_native"), F.coalesce("e_native", F.lit("day"))))
    grained = coords.withColumn("grain", F.explode(F.when(F.col("native") == "day", F.array(F.lit("day"), F.lit("month"))).otherwise(F.array("native"))))
    scoped = grained.withColumn("scope", F.explode(F.when(F.col("grain") == "year", F.array(F.lit("none"))).otherwise(F.array(F.lit("none"), F.lit("year")))))
    # anchors are metadata: a few rows an event table, whatever the tables hold
    found = sorted(scoped.collect(), key=lambda r: (r.measure_time, r.event, r.align, r.event_time, r.grain, r.scope))
    extra = [r.asDict() for r in cells.filter("side = 'unglossed'").select("event", "align", F.col("term").alias("measure_time"), F.col("axis").alias("event_time"), "reason").collect()]
    if not found and not extra:
        return refuse("no anchor aligned: no cells on the measure side or the event side")
    id_of = {r.event: r.identifier_columns for r in ids.collect()}
    rows: list[dict] = []
    if found:
        keyed = spark.createDataFrame([(i, r.event, r.align, r.measure_align, r.measure_time, r.event_time, r.grain, r.scope) for i, r in enumerate(found)], "anchor int, event string, align string, measure_align string, measure_time string, event_time string, grain string, scope string")
        rows += _reconciled(cells, keyed, found, id_of) + _monotone(cells, found, id_of)
    rows += [u | {"result": "abstain", "alternatives": [], "kind": 0, "identifier_columns": id_of.get(u["event"])} for u in extra]
    rows.sort(key=lambda r: (r["measure_time"] or "", r["event"], r["align"], r["event_time"] or "", r["kind"], r.get("grain") or "~", r.get("scope") or "~"))
    names = [p.split(" ")[0] for p in ANCHOR_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"applicable": True, "seq": i, **r}.get(c) for c in names) for i, r in enumerate(rows)], ANCHOR_SCHEMA)


def _reconciled(cells: DataFrame, keyed: DataFrame, found: list, id_of: dict) -> list[dict]:
    k = F.broadcast(keyed)
    m = cells.filter("side = 'measure'").select(F.col("align").alias("measure_align"), F.col("axis").alias("measure_time"), "entity", "period", "value").join(k, ["measure_align", "measure_time"])
    m = m.groupBy("anchor", _scoped(F.col("entity"), F.col("scope"), F.col("period")).alias("entity"), _trunc(F.col("grain"), F.col("period")).alias("b")).agg(F.sum("value").alias("y"))
    e = cells.filter("side = 'event'").select("event", "align", F.col("axis").alias("event_time"), "entity", "period", "term", "value").join(k, ["event", "align", "event_time"])
    e = e.groupBy("anchor", _scoped(F.col("entity"), F.col("scope"), F.col("period")).alias("entity"), _trunc(F.col("grain"), F.col("period")).alias("b"), "term").agg(F.sum("value").alias("m"))
    periods = m.groupBy("anchor", "entity").agg(F.count("*").alias("n"))
    viable = {r.anchor: r.n for r in periods.filter(F.col("n") >= LEAST_PERIODS).groupBy("anchor").agg(F.count("*").alias("n")).collect()}
    terms = {r.anchor: r.n for r in e.groupBy("anchor").agg(F.count_distinct("term").alias("n")).collect()}
    runs = [i for i in range(len(found)) if viable.get(i, 0) >= 2 and terms.get(i, 0) >= 1]
    common = {r.anchor: r.n for r in periods.select("anchor", "entity").join(e.select("anchor", "entity").distinct(), ["anchor", "entity"], "left_semi").groupBy("anchor").agg(F.count("*").alias("n")).collect()}
    summaries: dict[int, list[dict]] = {}
    if runs:
        both = m.filter(F.col("anchor").isin(runs)).join(e, ["anchor", "entity", "b"])
        small = [i for i in runs if terms[i] <= MOST_PAIRED_TERMS]
        other = both.filter(F.col("anchor").isin(small)).select("anchor", "entity", "b", F.col("term").alias("t2"), F.col("m").alias("m2")) if small else None
        conv = both.select("anchor", "entity", "b", "y", F.col("term").alias("convention"), F.lit(1).alias("terms"), "m")
        if other is not None:
            conv = conv.unionByName(both.join(other, ["anchor", "entity", "b"]).filter("term <> t2").select("anchor", "entity", "b", "y", F.concat("term", F.lit(" - "), "t2").alias("convention"), F.lit(2).alias("terms"), (F.col("m") - F.col("m2")).alias("m")))
        v = votes(conv, ["anchor", "convention", "terms", "entity"])
        tally = F.struct(F.count("vote").alias("voted"), F.count(F.when(F.col("vote") == STOCK, 1)).alias("stock"), F.count(F.when(F.col("vote") == FLOW, 1)).alias("flow"))
        sums = [tally.alias("t")]
        for label, key in ((STOCK, "s"), (FLOW, "f")):
            won, same = F.col("vote").eqNullSafe(label), F.col("mirror").eqNullSafe(label)
            fits = F.least("r_flow", "r_stock")
            sums.append(F.struct(F.median(F.when(won, F.col("r_flow"))).alias("r_flow"), F.median(F.when(won, F.col("r_stock"))).alias("r_stock"), F.count(F.when(won & ~same, 1)).alias("primary"), F.count(F.when(~won & same, 1)).alias("mirror"), F.count(F.when(won & same, 1)).alias("both"), F.sum(F.when(won, fits * fits)).alias("rss"), F.count(F.when(won, 1)).alias("fired")).alias(key))
        per = v.groupBy("anchor", "convention", "terms").agg(*sums)
        label = F.when(F.col("t.stock") > F.col("t.flow"), STOCK).otherwise(FLOW)
        side = F.when(F.col("t.stock") > F.col("t.flow"), F.col("s")).otherwise(F.col("f"))
        bic = F.when(F.col("d.fired") > 0, F.col("d.fired") * F.log(F.greatest(F.col("d.rss"), F.lit(1e-12)) / F.col("d.fired")) + F.col("terms") * F.log(F.col("d.fired")))
        told = per.select("anchor", "convention", "terms", "t", label.alias("label"), side.alias("d")).withColumn("bic", bic)
        n_common = F.element_at(F.create_map(*[F.lit(x) for i in runs for x in (i, common.get(i, 0))]), F.col("anchor"))
        told = told.withColumn("support", wilson_lower(F.greatest("t.stock", "t.flow"), n_common))
        for r in told.collect():
            winners = max(r.t.stock, r.t.flow)
            agreement = winners / r.t.voted if r.t.voted else 0.0
            result = r.label if r.t.voted >= LEAST_VOTERS and agreement >= LEAST_AGREEMENT else "abstain"
            summaries.setdefault(r.anchor, []).append({"convention": r.convention, "terms": r.terms, "voted": r.t.voted, "winners": winners, "agreement": agreement, "result": result, "support": r.support, "bic": r.bic, "d": r.d})
    out = []
    for i, a in enumerate(found):
        ss, n = summaries.get(i, []), common.get(i, 0)
        row = {"event": a.event, "align": a.align, "measure_time": a.measure_time, "event_time": a.event_time, "grain": a.grain, "scope": a.scope, "viable_entities": viable.get(i, 0), "identifier_columns": id_of.get(a.event), "entities": n if i in runs else None, "result": "abstain", "alternatives": [], "kind": 0}
        deciders = [s for s in ss if s["result"] != "abstain" and s["winners"] >= 0.5 * max(n, 1)]
        floored = sorted((s for s in ss if s["result"] != "abstain"), key=lambda s: (-s["winners"] / max(n, 1), s["convention"]))
        best = None
        if deciders:
            lone: dict[float, float] = {}
            for s in deciders:
                if s["terms"] == 1 and s["bic"] is not None:
                    lone[round(s["support"], 8)] = min(s["bic"], lone.get(round(s["support"], 8), float("inf")))

            def place(s: dict) -> tuple:
                tie = round(s["support"], 8)
                decisive = s["terms"] != 1 and tie in lone and s["bic"] is not None and lone[tie] - s["bic"] > DECISIVE
                return -tie, 1 if s["terms"] == 1 else 0 if decisive else 2, s["convention"]

            best = min(deciders, key=place)
            row |= {k: best[k] for k in ("result", "convention", "voted", "agreement", "support")} | {"r_flow": best["d"].r_flow, "r_stock": best["d"].r_stock, "sign_primary": best["d"].primary, "sign_mirror": best["d"].mirror, "sign_both": best["d"].both}
        elif floored:
            row["voted"] = floored[0]["voted"]
        others = sorted((s for s in ss if s is not best), key=lambda s: (-s["voted"], -s["support"], s["convention"]))[:4]
        row["alternatives"] = [(s["convention"], s["result"] if s in deciders else "abstain", s["voted"], s["support"]) for s in others]
        if viable.get(i, 0) < 2:
            row["reason"] = "fewer than two entities carry 4+ periods on this alignment"
        elif best is None:
            why = f"{floored[0]['winners']} of {n} common entities voted {floored[0]['result']}: under the majority floor" if floored else "votes below the candidacy floor (2 voters, 0.8 agreement)" if any(s["voted"] for s in ss) else "no entity series reconciled: wrong anchor, short series, or dead values"
            row["reason"] = why + ("; pairs not scored above 8 terms" if terms.get(i, 0) > MOST_PAIRED_TERMS else "")
        out.append(row)
    return out


def _monotone(cells: DataFrame, found: list, id_of: dict) -> list[dict]:
    """One anchor per event, alignment and scope that reads the column's own shape: levels that never fall."""
    groups: dict[tuple, list] = {}
    for a in found:
        groups.setdefault((a.event, a.measure_align, a.scope), []).append(a)
    keys = []
    for (event, align, scope), g in sorted(groups.items()):
        first = min(g, key=lambda a: a.measure_time)
        keys.append((len(keys), event, align, scope, first.measure_time, first.m_native, min(a.align for a in g), min(a.event_time for a in g)))
    k = F.broadcast(cells.sparkSession.createDataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in keys], "k int, measure_align string, scope string, measure_time string, grain string"))
    s = cells.filter("side = 'measure'").select(F.col("align").alias("measure_align"), F.col("axis").alias("measure_time"), "entity", "period", "value").join(k, ["measure_align", "measure_time"])
    s = s.groupBy("k", _scoped(F.col("entity"), F.col("scope"), F.col("period")).alias("entity"), _trunc(F.col("grain"), F.col("period")).alias("b")).agg(F.sum("value").alias("y"))
    s = s.withColumn("before", F.lag("y").over(Window.partitionBy("k", "entity").orderBy("b"))).filter("before IS NOT NULL")
    per = s.groupBy("k", "entity").agg(F.count("*").alias("steps"), F.count(F.when(F.col("y") < F.col("before"), 1)).alias("down"), F.count(F.when(F.col("y") > F.col("before"), 1)).alias("up")).filter("steps >= 3")
    read = {r.k: r for r in per.groupBy("k").agg(F.count("*").alias("considered"), F.count(F.when((F.col("down") == 0) & (F.col("up") > 0), 1)).alias("monotone"), F.count(F.when((F.col("down") > 0) | (F.col("up") > 0), 1)).alias("movers"), F.sum("steps").alias("steps")).withColumn("support", wilson_lower(F.col("monotone"), F.col("movers"))).collect()}
    out = []
    for i, event, _, scope, measure_time, grain, align, event_time in keys:
        r = read.get(i)
        n, movers, mono = (r.considered, r.movers, r.monotone) if r else (0, 0, 0)
        row = {"event": event, "align": align, "measure_time": measure_time, "event_time": event_time, "grain": grain, "scope": scope, "entities": n, "viable_entities": n, "identifier_columns": id_of.get(event), "convention": "monotone", "alternatives": [], "kind": 1, "result": "abstain" if n < 2 or movers < 2 or mono * 2 < movers else STOCK}
        if n >= 2 and movers >= 2:
            row |= {"voted": movers, "agreement": mono / movers, "support": r.support}
        row["reason"] = "fewer than two entities carry 4+ periods at the native grain" if n < 2 else f"{movers} of {n} entities move within the scope: no monotone evidence" if movers < 2 else f"{movers - mono} of {movers} moving entities decrease within the scope over {r.steps} steps: not a cumulative here" if mono * 2 < movers else None
        out.append(row)
    return out


def additivity_evidence(anchors: DataFrame) -> dict:
    """The election among the anchors of a column: {applicable, reason, anchors_n, decided, summary, anchors}."""
    rows = [r.asDict(recursive=True) for r in anchors.orderBy("seq").collect()]
    if not all(r["applicable"] for r in rows):
        return {"applicable": False, "reason": min(r["reason"] for r in rows if not r["applicable"]), "anchors_n": None, "decided": None, "summary": None, "anchors": None}
    mono = lambda r: r["convention"] == "monotone"
    decided = sorted((r for r in rows if r["result"] != "abstain"), key=lambda r: (-round(r["support"], 8), mono(r), -r["voted"], r["event"], r["align"]))
    summary = {k: None for k in ("event", "align", "grain", "scope", "convention", "support", "voted", "r_flow", "r_stock", "sign", "tiebreak", "reason")} | {"result": "abstain"}
    if decided:
        top = decided[0]
        summary |= {k: top[k] for k in ("result", "event", "align", "grain", "scope", "convention", "support", "voted", "r_flow", "r_stock")}
        if top["sign_primary"] is not None:
            summary["sign"] = {"primary": top["sign_primary"], "mirror": top["sign_mirror"], "both": top["sign_both"]}
        if len(decided) > 1 and abs(top["support"] - decided[1]["support"]) <= 1e-9:
            summary["tiebreak"] = "reconciliation-over-monotone" if mono(top) != mono(decided[1]) else "voted" if top["voted"] != decided[1]["voted"] else "event-name"
    else:
        summary["reason"] = min(rows, key=lambda r: (mono(r), r["entities"] is None, -(r["voted"] if r["voted"] is not None else -1), r["seq"]))["reason"]
    return {"applicable": True, "reason": None, "anchors_n": len(rows), "decided": len(decided), "summary": summary, "anchors": rows}
