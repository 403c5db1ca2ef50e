"""Operators against worked examples and brute force."""

import datetime
import itertools
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.catalog.jsonschema import check
from ledgerlens.functions import geometry
from ledgerlens.functions import quantiles as quantile_functions
from ledgerlens.functions.quantiles import at_rank
from ledgerlens.operators import additivity, cells, derivation, hierarchy, loads, profiles, relationships, series
from ledgerlens.plans.lineage import lineage


def test_column_profile(spark):
    df = spark.createDataFrame([(1, 0.0, "a", [1]), (2, -0.0, None, [2]), (3, None, "b", None)], "i int, x double, s string, l array<int>")
    got = {r.column: r for r in profiles.column_profile(df).collect()}
    assert set(got) == {"i", "x", "s"}
    assert got["x"].distinct == 1 and got["x"].null_ratio == pytest.approx(1 / 3)
    assert (got["i"].min, got["i"].max, got["s"].distinct) == ("1", "3", 2)
    empty = {r.column: r for r in profiles.column_profile(df.limit(0)).collect()}
    assert empty["i"].total == 0 and empty["i"].null_ratio == 0.0 and empty["i"].min is None


def test_outliers(spark):
    df = spark.createDataFrame([(1.5 * i, str(i), "x") for i in range(4)], "a double, t string, w string")
    r = profiles.outlier_profile(df, "a").first()
    assert (r.applicable, r.lower, r.upper, r.iqr_count) == (True, -2.25, 6.75, 0)
    assert profiles.outlier_profile(df, "t").first().parsed == 4
    assert not profiles.outlier_profile(df, "w").first().applicable
    flat = spark.createDataFrame([(1.0,)] * 9 + [(100.0,)], "a double")
    assert profiles.outlier_profile(flat, "a").first().z_count == 0  # no deviation to measure by


def test_exact_ranks_by_histograms(spark):
    xs = [float(x) for x in (5, 1, 1, 1, 1e12, -7, 3.25, 3.25, 0)] + [1e-3 * k for k in range(50)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert at_rank(df, [0, 7, 30, len(xs) - 1]) == [sorted(xs)[k] for k in (0, 7, 30, len(xs) - 1)]


def test_ranks_share_passes(spark, monkeypatch):
    """All ranks are found in as many passes as one; infinities and NaN have their ranks too."""
    xs = [1e-3 * k * k for k in range(5000)] + [math.inf, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in xs + [math.nan]], "x double")
    passes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(1) or collect(self))
    at_rank(df, [2500])
    one = len(passes)
    ranks = [0, 1, 1250, 1251, 2500, 3750, 3751, len(xs) - 2, len(xs) - 1]
    assert at_rank(df, ranks) == [sorted(xs)[k] for k in ranks]
    assert len(passes) - one <= one + 2
    monkeypatch.undo()
    assert math.isnan(at_rank(df, [len(xs)])[0])


def test_outliers_of_many_rows(spark, monkeypatch):
    """Beyond what the built-in aggregate takes, the same profile; numbers are not read by way of their text."""
    df = spark.createDataFrame([(i * i / 7, i * i, i / 10, str(i)) for i in range(2000)], "d double, l bigint, f float, s string")
    want = {c: profiles.outlier_profile(df, c).first() for c in df.columns}
    monkeypatch.setattr(quantile_functions, "IN_MEMORY", 0)
    for c in df.columns:
        out = profiles.outlier_profile(df, c)
        assert out.first() == pytest.approx(want[c])
        assert ("as string" in out._jdf.queryExecution().toString().lower()) == (c in "fs")


def _dates(spark, *days):
    return spark.sql("SELECT explode(array(" + ", ".join(f"DATE'{d}'" for d in days) + ")) AS d")


def test_temporal(spark):
    daily = _dates(spark, *[f"2024-01-{d:02d}" for d in (*range(1, 6), *range(11, 16))])
    r = profiles.temporal_profile(daily, "d").first()
    assert (r.granularity, r.confidence, r.actual, r.expected, r.gap_count) == ("day", 0.5, 10, 15, 1)
    assert (r.gap_sample[0].days, r.gap_sample[0].severity, r.gap_sample[0].missing_periods) == (6.0, "moderate", 5)
    r = profiles.temporal_profile(_dates(spark, "2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01", "2024-02-01"), "d").first()
    assert (r.granularity, r.actual, r.expected, r.gap_count) == ("month", 4, 4, 0) and r.confidence > 0.98
    r = profiles.temporal_profile(_dates(spark, "2025-01-01", "2025-02-01", "2025-04-01"), "d").first()
    assert (r.granularity, r.actual, r.expected) == ("month", 3, 4)
    r = profiles.temporal_profile(_dates(spark, "2024-01-01", "2024-01-01"), "d").first()
    assert (r.granularity, r.confidence, r.span_days, r.expected) == ("unknown", 0.0, 0.0, None)
    r = profiles.temporal_profile(spark.createDataFrame([(1.0,)], "d double"), "d").first()
    assert not r.applicable and "DOUBLE" in r.reason


def test_cells(spark):
    df = spark.createDataFrame([(1, None, [1])], "rn int, `column` string, l array<int>")
    got = cells.dataset_cells(spark, {"odd": df, "a": df.select("rn")}).orderBy("ci").collect()
    assert [(r.table, r.column, r.ci, r.val) for r in got] == [("a", "rn", 1, "1"), ("odd", "rn", 2, "1"), ("odd", "column", 3, None)]
    wide = spark.range(1000).selectExpr("id AS a", "id % 7 AS b", "id % 3 AS c", "'x' AS d")
    assert 40 < cells.dataset_cells(spark, {"w": wide}, cells=400).count() / 4 < 160
    assert cells.dataset_cells(spark, {"w": wide}, cells=400).count() == cells.dataset_cells(spark, {"w": wide}, cells=400).count()
    with pytest.raises(ValueError):
        cells.dataset_cells(spark, {"w": wide}, cells=0)


def test_relationship_checks(spark):
    ts = lambda d: f"TIMESTAMP'2024-01-{d:02d}'"
    invoices = spark.sql("SELECT explode(sequence(1, 18)) AS invoice_id").selectExpr("CAST(invoice_id AS BIGINT) AS invoice_id", f"{ts(10)} AS inv_date")
    payments = spark.sql("SELECT explode(sequence(1, 20)) AS i").selectExpr("i AS pay_id", "CAST(CASE WHEN i > 18 THEN 80 + i ELSE i END AS BIGINT) AS invoice_id", f"CASE WHEN i <= 3 THEN {ts(1)} ELSE {ts(20)} END AS pay_date")
    r = relationships.relationship_check(payments, ["invoice_id"], invoices, ["invoice_id"], "p -> i").first()
    assert (r.filled, r.orphans, r.orphan_rate, r.orphan_distinct, r.joined, r.precedes) == (20, 2, 0.1, 2, 18, 3)
    assert [(k.key, k.rows) for k in r.orphan_keys] == [("100", 1), ("99", 1)]
    pair = spark.createDataFrame([("a", "x" * 150), ("a", None)], "k1 string, k2 string")
    r = relationships.relationship_check(pair, ["k1", "k2"], pair.limit(0), ["k1", "k2"], "x").first()
    assert r.filled == 1 and r.orphan_keys[0].key == '["a","' + "x" * 100 + '"]'
    geo = spark.createDataFrame([("rome", "it"), ("rome", "it"), ("paris", "fr"), ("paris", "us")], "city string, country string")
    r = relationships.relationship_check(geo, ["city"], geo, ["country"], "c", same_table=True).first()
    assert (r.filled, r.orphans, r.orphan_keys) == (4, 2, None)
    assert not relationships.relationship_checks(spark, {}, []).first().applicable


def test_relationship_candidates_and_rescue(spark):
    statement = spark.createDataFrame([(i % 2, f"r{i // 2 + 1}") for i in range(20)], "account_no int, reference string")
    payment = spark.createDataFrame([(0, "r1"), (1, "r1"), (0, "r3"), (1, "r9")], "account_no int, reference string")
    got = relationships.relationship_candidates(spark, {"statement": statement, "payment": payment}).collect()
    rescue = [r for r in got if r.kc_from]
    assert any(r.from_col.startswith("payment.") and {r.from_col, r.kc_from} == {"payment.account_no", "payment.reference"} and r.to_unique for r in rescue)
    none = relationships.relationship_candidates(spark, {"a": spark.range(3), "b": spark.createDataFrame([("x",)], "s string")}).collect()
    assert len(none) == 1 and none[0].seq is None


def brute_candidates(tables):
    """tables: name -> (columns, rows), all columns of one type; (from, to, cardinality, matched, kc_from, kc_to) of every candidate."""
    cols = [(t, i) for t in sorted(tables) for i in range(len(tables[t][0]))]
    name = lambda c: f"{c[0]}.{tables[c[0]][0][c[1]]}"
    held = {c: [r[c[1]] for r in tables[c[0]][1] if r[c[1]] is not None] for c in cols}
    own = {c: set(v) for c, v in held.items()}
    unique = {c: len(own[c]) == len(held[c]) for c in cols}
    kind = lambda f, t: ("one" if f else "many") + "-to-" + ("one" if t else "many")
    admitted = [(f, k) for f in cols for k in cols if f != k and own[f] & own[k] and len(own[k]) >= 2 and 2 * len(own[f] & own[k]) >= len(own[f])]
    single = [(f, k) for f, k in admitted if len(own[k]) >= 0.9 * len(held[k])]
    out = {(name(f), name(k), kind(unique[f], unique[k]), len(own[f] & own[k]), None, None) for f, k in single}
    both = lambda a, b: [(r[a[1]], r[b[1]]) for r in tables[a[0]][1] if r[a[1]] is not None and r[b[1]] is not None]
    keyed = {frozenset((f[0], k[0])) for f, k in single}
    for pf, pk in admitted:
        if (pf, pk) in single or frozenset((pf[0], pk[0])) in keyed:
            continue
        found = []
        for sf, sk in admitted:
            if (sf[0], sk[0]) != (pf[0], pk[0]) or sf == pf or sk == pk or unique[sk]:
                continue
            left, right = both(pf, sf), both(pk, sk)
            a, b = set(left), set(right)
            if left and right and len(b) >= 2 and len(b) >= 0.9 * len(right) and len(b) >= 0.5 * len(a) and len(b) > len(own[sk]) and len(own[pk]) * len(own[sk]) >= 0.9 * len(right) and 2 * len(a & b) >= len(a):
                found.append((-len(own[sf] & own[sk]) / len(own[sf]), cols.index(sf), cols.index(sk), sf, sk, len(a) == len(left), len(b) == len(right), len(a & b)))
        if found:
            *_, sf, sk, f_unique, k_unique, n = min(found)
            (f, k), (cf, ck) = ((pf, pk), (sf, sk)) if len(own[pk]) >= len(own[sk]) else ((sf, sk), (pf, pk))
            out.add((name(f), name(k), kind(f_unique, k_unique), n, name(cf), name(ck)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_relationship_candidates_brute(spark, seed):
    rng = random.Random(seed)
    long = lambda x: None if x is None else f"{x:04d}" * 40 if x % 2 else str(x)
    maybe = lambda x, p=0.05: None if rng.random() < p else x
    grid = list(itertools.product(range(6), range(20, 29)))
    tables = {
        "line": (["doc", "pos", "v"], [(maybe(a), maybe(b), maybe(rng.randrange(9000, 9900))) for a, b in rng.choices(grid, k=70)]),
        "grid": (["doc", "pos", "w"], [(a, b, maybe(rng.randrange(7000, 7005))) for a, b in grid[: rng.randrange(45, 55)]]),
        "owner": (["id", "x"], [(i, maybe(rng.randrange(500, 530))) for i in range(500, 540)]),
        "none": (["n"], [(None,)] * 3)}
    tables = {t: (c, [tuple(map(long, r)) for r in rows]) for t, (c, rows) in tables.items()}
    frames = {t: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)) for t, (columns, rows) in tables.items()}
    want = brute_candidates(tables)
    got = relationships.relationship_candidates(spark, frames).collect()
    assert any(w[4] for w in want) and any(not w[4] for w in want)
    assert {(r.from_col, r.to_col, r.cardinality, r.matched, r.kc_from, r.kc_to) for r in got} == want


@pytest.mark.parametrize("few", [(0, 50_000), (0, 0)])
def test_relationship_candidates_narrowed(spark, monkeypatch, few):
    """Composite keys are narrowed without loss, and pairs of values that can't be in common often enough aren't counted on the side of the key."""
    monkeypatch.setattr(relationships, "FEW_ROWS", few[0])
    monkeypatch.setattr(relationships, "FEW_PAIRS", few[1])
    kept, narrowed = [], relationships._narrowed
    monkeypatch.setattr(relationships, "_narrowed", lambda tables, cols, scoped, *a: kept.append((scoped, narrowed(tables, cols, scoped, *a))) or kept[-1][1])
    for seed in range(2):
        test_relationship_candidates_brute(spark, seed)
    statement = spark.createDataFrame([(i % 2, f"r{i // 2 + 1}") for i in range(20)], "account_no int, reference string")
    payment = spark.createDataFrame([(i % 2, f"r{i // 4 + 1}") for i in range(0, 20, 3)] + [(0, "r1")] * 9, "account_no int, reference string")
    got = relationships.relationship_candidates(spark, {"statement": statement, "payment": payment}).collect()
    assert any(r.kc_from for r in got) and len(kept) == 3 and all(after for _, after in kept)


def test_relationship_candidates_values(spark):
    """Values meet as their texts do, without being spelt out: both zeros apart, instants with and without a zone, more columns than a mask's word."""
    rows = "SELECT explode(sequence(0, 9)) AS i"
    a = spark.sql(f"SELECT CASE WHEN i = 0 THEN -0.0D WHEN i = 1 THEN double('NaN') WHEN i = 9 THEN NULL ELSE CAST(i AS DOUBLE) END AS x, timestamp_seconds(i) AS t FROM ({rows})")
    b = spark.sql(f"SELECT CASE WHEN i = 1 THEN double('NaN') ELSE CAST(i AS DOUBLE) END AS x, CAST(timestamp_seconds(i) AS TIMESTAMP_NTZ) AS t FROM ({rows})")
    got = {(r.from_col, r.to_col): r for r in relationships.relationship_candidates(spark, {"a": a, "b": b}).collect()}
    assert {k: (r.matched, r.from_distinct, r.to_distinct) for k, r in got.items()} == {("a.x", "b.x"): (8, 9, 10), ("b.x", "a.x"): (8, 10, 9), ("a.t", "b.t"): (10, 10, 10), ("b.t", "a.t"): (10, 10, 10)}
    wide = spark.sql(rows).selectExpr(*[f"i + {1000 * k} AS c{k}" for k in range(70)])
    one = spark.sql(rows).selectExpr("i + 69000 AS k")
    found = relationships.relationship_candidates(spark, {"wide": wide, "one": one}).collect()
    assert {(r.from_col, r.to_col, r.matched) for r in found} == {("wide.c69", "one.k", 10), ("one.k", "wide.c69", 10)}
    cells, made = [], relationships._masked

    def masked(*args):
        out = made(*args)
        cells.append({f.name: f.dataType.simpleString() for f in out.schema.fields})
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(relationships, "_masked", masked)
        relationships.relationship_candidates(spark, {"a": a, "b": b})
    assert cells == [{"v0": "double", "m0": "bigint"}, {"v0": "timestamp_ntz", "m0": "bigint"}]  # not as texts


def brute_votes(measure, event, grain, scope):
    """What one anchor of one event term says: (entities, viable, votes, r_flow of each entity)."""
    at = lambda d: d.replace(day=1) if grain == "month" else d
    summed = lambda cells: {k: sum(v for e, d, v in cells if (f"{e}@{d.year}" if scope == "year" else e, at(d)) == k) for k in {(f"{e}@{d.year}" if scope == "year" else e, at(d)) for e, d, _ in cells}}
    m, e = summed(measure), summed(event)
    viable = {x for x in {k[0] for k in m} if sum(k[0] == x for k in m) >= 4}
    told = {}
    for x in {k[0] for k in m} & {k[0] for k in e}:
        both = sorted(k for k in m if k[0] == x and k in e)
        y, mv = [m[k] for k in both], [e[k] for k in both]
        over = lambda a, b: a / b if b > 0 else math.inf
        rf = over(sum(abs(a - b) for a, b in zip(y, mv)), sum(map(abs, mv)))
        rs = over(sum(abs(y[i] - y[i - 1] - mv[i]) for i in range(1, len(y))), sum(map(abs, mv[1:])))
        low, high = min(rf, rs), max(rf, rs)
        margin = 0 if math.isinf(low) else 1 if math.isinf(high) else 0 if high == 0 else (high - low) / (high + low)
        fires = len(y) >= 4 and min(y) != max(y) and any(mv) and low <= 0.05 and margin >= 1 / 3
        told[x] = ("semi-additive" if rs < rf else "additive") if fires else None
    return len({k[0] for k in m} & {k[0] for k in e}), len(viable), told


def test_additivity_anchors_brute(spark):
    """All anchors of two tables of cells: every grain and scope, stocks and flows, and one entity that neither fits."""
    rng = random.Random(4)
    start = datetime.datetime(2023, 1, 1)
    event, stock, flow = [], [], []
    for e in "abcdef":
        level = 0.0
        for k in range(20):
            day = start + datetime.timedelta(days=31 * k)
            amount = float(rng.randrange(-50, 90))
            level += amount
            event.append((e, day, amount))
            stock.append((e, day, level if e != "f" else float(rng.randrange(1000))))
            flow.append((e, day, amount))
    schema = "side string, event string, align string, measure_align string, axis string, term string, identifier boolean, entity string, period timestamp, value double, reason string"
    for measure, result in ((stock, "semi-additive"), (flow, "additive")):
        rows = [("measure", None, "acct", None, "day", None, None, *c, None) for c in measure] + [("event", "moves", "acct", None, "day", "amount", None, *c, None) for c in event]
        rows.append(("alignment", "moves", "acct", "acct", "day", None, None, None, None, None, None))
        found = additivity.additivity_anchors(spark.createDataFrame(rows, schema)).collect()
        got = {(r.grain, r.scope): r for r in found if r.convention != "monotone"}
        assert set(got) == {(g, s) for g in ("day", "month") for s in ("none", "year")}
        assert {r.scope for r in found if r.convention == "monotone"} == {"none", "year"}
        for (grain, scope), r in got.items():
            entities, viable, told = brute_votes(measure, event, grain, scope)
            votes = [v for v in told.values() if v]
            wins = votes.count(result)
            p = wins / entities
            bound = (p + 1.9208 / entities - 1.96 * math.sqrt(p * (1 - p) / entities + 0.9604 / entities**2)) / (1 + 3.8416 / entities)
            assert wins >= 0.8 * len(votes) and wins >= 0.5 * entities
            assert (r.entities, r.viable_entities, r.result, r.convention, r.voted) == (entities, viable, result, "amount", len(votes))
            assert r.agreement == pytest.approx(wins / len(votes)) and r.support == pytest.approx(bound)


def test_hierarchy(spark):
    geo = spark.range(108).selectExpr("concat('z', id % 27) AS zip", "concat('c', (id % 27) % 9) AS city", "concat('k', (id % 27) % 9) AS city_code", "concat('s', (id % 27) % 3) AS state", "1.5D * id AS amount")
    got = {(r.from_col, r.to_col): r for r in hierarchy.hierarchy_candidates(geo).collect()}
    assert got["zip", "city"].g3 == 0 and got["zip", "city"].gk_lambda == 1 and got["city", "zip"].g3 > 0.05
    kinds = {(r.from_col, r.to_col): r.kind for r in hierarchy.detect_hierarchies(hierarchy.hierarchy_candidates(geo)).collect()}
    assert kinds["city", "city_code"] == "alias" and kinds["city", "state"] == "edge" and ("state", "city") not in kinds
    assert hierarchy.hierarchy_candidates(geo.limit(0)).first().reason == "empty table"
    assert hierarchy.hierarchy_candidates(geo.select("zip")).first().reason == "fewer than two dimension-like columns"


def test_derivation(spark):
    lines = spark.range(40).selectExpr("id + 1 AS units", "2.5D AS unit_price", "(id + 1) * 2.5D * CASE WHEN id < 2 THEN 1.15D ELSE 1 END AS line_amount", "100D + id AS net", "20D + id AS tax", "120D + 2 * id AS gross")
    got = {(r.target, r.form): (r.support, r.violations) for r in derivation.detect_derivations(derivation.derivation_candidates(lines)).collect()}
    assert got["line_amount", "product"] == (40, 2) and got["gross", "sum"] == (40, 0)
    assert not derivation.derivation_candidates(lines.select("units", "net")).first().applicable


def test_series(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-05', 1D, 'a'), (TIMESTAMP'2024-01-20', 3D, NULL), (TIMESTAMP'2024-02-01', 5D, 'a') v(t, x, d)")
    got = {(r.dimension, r.member, r.period.month): r.value for r in series.series_aggregate(spark, {"v": df}, [series.Axes("v", "t", "x", "month", dimensions=("d",)), series.Axes("gone", "t", "x", "month"), series.Axes("v", "t", "x", None)]).collect()}
    assert got == {("", "", 1): 4.0, ("", "", 2): 5.0, ("d", "a", 1): 1.0, ("d", "NULL", 1): 3.0, ("d", "a", 2): 5.0}
    assert sorted(r.value for r in series.folded(df, "t", "x", additivity="semi-additive").collect()) == [3.0, 5.0]


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (None, "m")], "k int, v string")
    table, counts = loads.merged(old, new, ["k"])
    assert sorted(map(str, table.collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (2, None), (None, "m"), (3, "c")], "k int, v string").collect()))
    assert tuple(counts.first()) == (1, 1, 2)
    assert loads.fingerprint(table).first() == loads.fingerprint(table.orderBy(F.rand())).first()


def test_lineage_of_unions_and_shapes(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lin")
    spark.sql("CREATE TABLE IF NOT EXISTS lin.o USING parquet AS SELECT 1 AS id, 2.5D AS amount, 'a' AS seg")
    got = lineage(spark.sql("SELECT seg, sum(amount) / count(*) AS r, avg(amount) AS a FROM lin.o GROUP BY seg UNION ALL SELECT 'z', id, 0D FROM (SELECT DISTINCT id FROM lin.o) WHERE id > 3"))
    assert got.complete and got.columns[1]["shape"] == "ratio" and got.columns[2]["shape"] == "average"
    assert {(m["column"], m["branch"]) for m in got.mapping} == {("seg", 0), ("r", 0), ("a", 0), ("r", 1)}
    assert "z" in got.literals and got.conditions[0]["table"] == "lin.o"
    joined = lineage(spark.sql("SELECT o.id FROM lin.o o JOIN (SELECT id, max(amount) AS m FROM lin.o GROUP BY id) g ON o.seg = CAST(g.id AS STRING)"))
    assert joined.joins and joined.joins[0]["left"] == "lin.o.seg"
    spark.sql("DROP DATABASE lin CASCADE")


def test_geometry(spark):
    ring = [(0, 0), (0, 2), (3, 2), (3, 0), (0, 0)]
    square = struct.pack("<BII I", 1, 3, 1, 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = struct.pack(">BI2d", 0, 1, 5.0, -1.0)
    assert geometry.measure(square)["area"] == 6.0 and geometry.measure(point)["kind"] == "POINT" and geometry.measure(b"\x01")["kind"] is None
    df = spark.createDataFrame([(bytearray(square),), (bytearray(point),), (None,), (bytearray(b"xx"),)], "g binary")
    r = geometry.geometry_profile(df, "g").first()
    assert (r.total, r.null_ratio, r.invalid, r.area_sum, tuple(r.extent)) == (4, 0.25, 1, 6.0, (0.0, -1.0, 5.0, 2.0))


_json = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(_json)
def test_schema_laws(value):
    assert check(True, value) is None and check(False, value) is not None
    assert check({"const": value}, value) is None and check({"enum": [value]}, value) is None
    assert (check({"not": {"type": "object"}}, value) is None) == (not isinstance(value, dict))
    any_of = {"anyOf": [{"type": "string"}, {"type": "array"}]}
    assert (check(any_of, value) is None) == isinstance(value, (str, list))


def test_schema_messages():
    schema = {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "minimum": 1}, "l": {"items": {"maxLength": 2}, "minItems": 1}}, "additionalProperties": False}
    assert check(schema, {}) == "$: v is required"
    assert check(schema, {"v": 0}) == "$.v: must be at least 1"
    assert check(schema, {"v": True}).startswith("$.v: expected")
    assert check(schema, {"v": 1, "l": ["ab", "abc"]}) == "$.l[1]: longer than 2"
    assert check(schema, {"v": 1, "w": 1}) == "$: w is not allowed"
    assert check({"oneOf": [{"type": "integer"}, {"minimum": 0}]}, 3) == "$: meets 2 of oneOf, not one"
    assert not math.isnan(1.0)


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hierarchy_queries_read_whole_tables(spark, monkeypatch):
    from ledgerlens import queries

    bounded = cells.bounded
    monkeypatch.setattr(hierarchy, "bounded", lambda df, most, width: bounded(df, most and 100, width))
    sf = "/root/testdata/sf0.001"
    for name, table in (("hierarchy_part", "part"), ("hierarchy_nation", "customer")):
        n = spark.read.parquet(f"{sf}/{table}.parquet").count()
        assert n > 33 and {r.rows for r in queries.queries()[name](spark, sf).collect()} == {n}
