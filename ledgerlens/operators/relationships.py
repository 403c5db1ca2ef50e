"""Whether declared relationships hold, and which undeclared ones the values suggest."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import INTEGERS, is_scalar, is_temporal, type_name

CHECK_SCHEMA = "applicable boolean, reason string, seq bigint, relationship string, filled bigint, orphans bigint, orphan_rate double, orphan_keys array<struct<key:string,rows:bigint>>, orphan_distinct bigint, pair_seq bigint, child_column string, parent_column string, joined bigint, precedes bigint, precedes_rate double"
TOP_ORPHANS, DATE_COLUMNS, KEY_LENGTH = 3, 3, 100


def _keyed(df: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Rows with every key filled: k1[, k2] as text, and d1.. of ``extra``."""
    cols = [F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys, 1)] + [F.col(f"`{c}`").cast("timestamp").alias(f"d{i}") for i, c in enumerate(extra, 1)]
    own = df.select(*cols)
    for i in range(1, len(keys) + 1):
        own = own.filter(F.col(f"k{i}").isNotNull())
    return own


def _key_text(n: int):
    cut = [F.substring(f"k{i}", 1, KEY_LENGTH) for i in range(1, n + 1)]
    return cut[0] if n == 1 else F.to_json(F.array(*cut))


def relationship_check(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str], name: str, seq: int = 1, same_table: bool = False) -> DataFrame:
    """One row per pair of date columns of a declared edge (one row if there is none), over the key and date columns only.

    Child rows are summed by key before they meet the parent's distinct keys, so a hot key meets as one row. Edges
    inside one table count the rows whose key reaches several parents instead, where the parent key isn't unique.
    """
    spark, n = child.sparkSession, len(child_keys)
    if n not in (1, 2) or len(parent_keys) != n:
        return spark.createDataFrame([(False, f"keys of {n} columns are not checked", seq, name, *[None] * 11)], CHECK_SCHEMA)
    keys = [f"k{i}" for i in range(1, n + 1)]
    c = _keyed(child, child_keys).groupBy(*keys).agg(F.count("*").alias("rows"))
    p = _keyed(parent, parent_keys).groupBy(*keys).agg(F.count("*").alias("_rows"))
    none = F.lit(None).cast("array<struct<key:string,rows:bigint>>")
    if same_table:
        both = child.select(*[F.col(f"`{x}`").cast("string").alias(f"k{i}") for i, x in enumerate(child_keys, 1)], F.struct(*[F.col(f"`{x}`").cast("string") for x in parent_keys]).alias("p"), F.greatest(F.lit(0), *[F.col(f"`{x}`").isNull().cast("int") for x in parent_keys]).alias("open"))
        for k in keys:
            both = both.filter(F.col(k).isNotNull())
        per = both.groupBy(*keys, "p", "open").agg(F.count("*").alias("rows")).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum((F.col("open") == 0).cast("long")).alias("reached"))
        unique = p.agg(F.coalesce(F.max("_rows"), F.lit(0)) <= 1).first()[0]
        told = per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(F.lit(not unique) & (F.col("reached") > 1), F.col("rows")).otherwise(0)), F.lit(0)).alias("orphans")).withColumn("orphan_keys", none).withColumn("orphan_distinct", F.lit(None).cast("long"))
    else:
        met = c.join(p, keys, "left").withColumn("lost", F.col("_rows").isNull())
        totals = met.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("rows"))), F.lit(0)).alias("orphans"), F.sum(F.col("lost").cast("long")).alias("orphan_distinct"))
        top = met.filter("lost").orderBy(F.col("rows").desc(), *keys).limit(TOP_ORPHANS).select(F.struct((-F.col("rows")).alias("o"), *keys).alias("o"), F.struct(_key_text(n).alias("key"), "rows").alias("k"))
        tops = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("orphan_keys"))
        told = totals.crossJoin(F.broadcast(tops)).withColumn("orphan_distinct", F.coalesce("orphan_distinct", F.lit(0)))
    edge = told.select(F.lit(True).alias("applicable"), F.lit(None).cast("string").alias("reason"), F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("relationship"), "filled", "orphans", F.when(F.col("filled") > 0, F.col("orphans") / F.greatest("filled", F.lit(1))).otherwise(0.0).alias("orphan_rate"), "orphan_keys", "orphan_distinct")
    dates = lambda df: [f.name for f in df.schema.fields if is_temporal(f.dataType)][:DATE_COLUMNS]
    cd, pd = ([], []) if same_table else (dates(child), dates(parent))
    pairs = [(i, j) for i in range(1, len(cd) + 1) for j in range(1, len(pd) + 1)]
    schema = "pair_seq bigint, child_column string, parent_column string, joined bigint, precedes bigint, precedes_rate double"
    if not pairs:
        found = spark.createDataFrame([], schema)
    else:
        right = _keyed(parent, parent_keys, pd).select(*keys, *[F.col(f"d{j}").alias(f"e{j}") for j in range(1, len(pd) + 1)])
        met = _keyed(child, child_keys, cd).join(right, keys)
        sums = met.agg(*[f.alias(f"{k}{i}_{j}") for i, j in pairs for k, f in (("j", F.count(F.when(F.col(f"d{i}").isNotNull() & F.col(f"e{j}").isNotNull(), 1))), ("p", F.count(F.when(F.col(f"d{i}") < F.col(f"e{j}"), 1))))])
        each = F.array(*[F.struct(F.lit(m).cast("long").alias("pair_seq"), F.lit(cd[i - 1]).alias("child_column"), F.lit(pd[j - 1]).alias("parent_column"), F.col(f"j{i}_{j}").alias("joined"), F.col(f"p{i}_{j}").alias("precedes")) for m, (i, j) in enumerate(pairs, 1)])
        found = sums.select(F.explode(each).alias("r")).select("r.*").filter("joined > 0").withColumn("precedes_rate", F.col("precedes") / F.col("joined"))
    return edge.join(F.broadcast(found), F.lit(True), "left")


def relationship_checks(spark: SparkSession, tables: dict[str, DataFrame], edges: list[dict]) -> DataFrame:
    """Checks of edges {child, child_keys, parent, parent_keys, name}; none declared is one row that says so."""
    out = None
    for seq, e in enumerate(edges, 1):
        part = relationship_check(tables[e["child"]], e["child_keys"], tables[e["parent"]], e["parent_keys"], e["name"], seq, e["child"] == e["parent"])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([(False, "no declared relationships", *[None] * 13)], CHECK_SCHEMA) if out is None else out


#: Texts of more characters than this meet as a digest and their length, so that no whole document is shuffled.
LONG_VALUE = 64
#: Holders of a value that one word of a mask tells.
WORD = 63
CANDIDATE_SCHEMA = "seq bigint, from_col string, to_col string, cardinality string, overlap double, matched bigint, orphans bigint, from_distinct bigint, to_distinct bigint, to_unique boolean, to_temporal boolean, kc_from string, kc_to string"
#: Composite keys over more rows than this are narrowed before they are counted; so many pairs of values of a group are broadcast.
FEW_ROWS, FEW_PAIRS = 2_000_000, 50_000
#: Types whose values are equal where their texts are.
_AS_STORED = (*INTEGERS, T.BooleanType, T.DateType, T.DecimalType)


def _value(column: str, kind: T.DataType):
    """What stands for a column's text where values meet, in a type that groups without being spelt out; null is minus zero, which has its own text."""
    own = F.col(f"`{column}`")
    if isinstance(kind, _AS_STORED):
        return own
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return own.cast("timestamp_ntz")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~((own == 0) & own.cast("string").startswith("-")), own)
    text = own.cast("string")
    return F.when(F.length(text) > LONG_VALUE, F.concat(F.md5(text.cast("binary")), F.lit(":"), F.length(text).cast("string"))).otherwise(text)


def _cardinality(f_unique: bool, t_unique: bool) -> str:
    return "one-to-one" if f_unique and t_unique else "many-to-one" if t_unique else "one-to-many" if f_unique else "many-to-many"


def relationship_candidates(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Which column of one table keys into which column of another, by value, within one stored type.

    The values of all columns of a type are reduced to one row a value with the set of columns that hold it; pairs of
    columns are counted from these sets, so a value costs one row however many rows hold it. What is left, a row a
    column and a row a set of columns, is metadata, and decided on the driver. Where no key joins two tables, a second
    column may scope the first (the composite rescue); the column pairs which that needs are counted together, like columns.
    """
    cols = [(t, f.name, type_name(f.dataType), is_temporal(f.dataType), f.dataType) for t in sorted(tables) for f in tables[t].schema.fields if is_scalar(f.dataType)]
    if not cols:
        return spark.createDataFrame([(None,) * 13], CANDIDATE_SCHEMA)
    rows_of, filled = _filled(tables, cols, [(i,) for i in range(len(cols))])
    distinct, met = _held(tables, cols, [(i,) for i in range(len(cols))])
    unique = {i: distinct[i] == filled[i] for i in distinct}
    key_like = {i: filled[i] > 0 and distinct[i] >= 2 and distinct[i] >= 0.9 * filled[i] for i in distinct}
    admitted = [(f, k) for (f, k), m in sorted(met.items()) if distinct[k] >= 2 and m / distinct[f] >= 0.5]
    pair = lambda f, k: frozenset((cols[f][0], cols[k][0]))
    singles = [(f, k) for f, k in admitted if key_like[k]]
    keyed = {pair(f, k) for f, k in singles}
    label = lambda i: f"{cols[i][0]}.{cols[i][1]}"
    found = [(0, k, f, label(f), label(k), _cardinality(unique[f], unique[k]), met[f, k] / distinct[f], met[f, k], distinct[f] - met[f, k], distinct[f], distinct[k], unique[k], cols[k][3], None, None) for f, k in singles]
    found += _rescues(tables, cols, rows_of, filled, distinct, unique, met, [(f, k) for f, k in admitted if not key_like[k] and pair(f, k) not in keyed], admitted, label)
    found.sort(key=lambda r: r[:5])
    rows = [(i, *r[3:]) for i, r in enumerate(found, 1)] or [(None,) * 13]
    return spark.createDataFrame(rows, CANDIDATE_SCHEMA)


def _filled(tables, cols, groups: list[tuple[int, ...]]) -> tuple[dict, dict]:
    """The rows of each table, and of each group of columns, by its place, the rows with all of them filled; one pass a table, without a shuffle."""
    rows_of, filled, out, owns = {}, {}, None, []
    for t in sorted({cols[g[0]][0] for g in groups}):
        own = [p for p, g in enumerate(groups) if cols[g[0]][0] == t]
        part = tables[t].agg(F.array(F.count(F.lit(1)), *[F.count(F.when(_present(cols, groups[p]), 1)) for p in own]).alias("n")).select(F.lit(len(owns)).alias("t"), "n")
        out = part if out is None else out.unionAll(part)
        owns.append((t, own))
    for r in out.collect():
        t, own = owns[r.t]
        rows_of[t] = r.n[0]
        filled |= dict(zip(own, r.n[1:]))
    return rows_of, filled


def _present(cols, group: tuple[int, ...]):
    return reduce(lambda a, b: a & b, [F.col(f"`{cols[c][1]}`").isNotNull() for c in group])


def _masked(tables, cols, groups: list[tuple[int, ...]], places: list[int], values: list[str], masks: list[str]) -> DataFrame:
    """A row for each row of a table and each of the groups at ``places`` that it fills: the values, and the bit of the group."""
    at = {p: divmod(j, WORD) for j, p in enumerate(places)}
    each = lambda p: F.struct(*[_value(cols[c][1], cols[c][4]).alias(v) for c, v in zip(groups[p], values)], *[F.when(_present(cols, groups[p]), F.lit(1 << at[p][1] if at[p][0] == w else 0).cast("long")).alias(m) for w, m in enumerate(masks)])
    rows = None
    for t in sorted({cols[groups[p][0]][0] for p in places}):
        part = tables[t].select(F.explode(F.array(*[each(p) for p in places if cols[groups[p][0]][0] == t])).alias("c")).select("c.*").filter("m0 IS NOT NULL")
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _kinds(cols, groups: list[tuple[int, ...]]) -> list[list[int]]:
    """The places of the groups, by the types of their columns."""
    kinds: dict[tuple, list[int]] = {}
    for p, g in enumerate(groups):
        kinds.setdefault(tuple(cols[c][2] for c in g), []).append(p)
    return list(kinds.values())


def _held(tables, cols, groups: list[tuple[int, ...]], within: list[tuple[int, ...]] = ()) -> tuple[dict, dict]:
    """The distinct values of each group of columns (by its place), and those that two groups of the same types have in common.

    Rows become a value and a mask with the bit of its group; masks of a value are joined where the rows are read and
    once more behind one exchange, so no more than a value and a few words travel, once from each task that holds it.
    Of groups whose types those of ``within`` share, only values of ``within`` count: these are few and are broadcast.
    """
    out, kinds = None, _kinds(cols, groups)
    for which, places in enumerate(kinds):
        values, masks = [f"v{i}" for i in range(len(groups[places[0]]))], [f"m{w}" for w in range(-(-len(places) // WORD))]
        rows = _masked(tables, cols, groups, places, values, masks)
        few = [g for g in within if [cols[c][2] for c in g] == [cols[c][2] for c in groups[places[0]]]]
        if few:
            own = _masked(tables, cols, few, range(len(few)), values, [f"m{w}" for w in range(-(-len(few) // WORD))]).select(*[F.col(v).alias(f"_{v}") for v in values]).distinct()
            rows = rows.join(F.broadcast(own), reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values]), "leftsemi")
        sets = rows.groupBy(*values).agg(*[F.bit_or(m).alias(m) for m in masks]).groupBy(*masks).agg(F.count("*").alias("n"))
        told = sets.select(F.lit(which).alias("which"), F.array(*masks).alias("mask"), "n")
        out = told if out is None else out.unionAll(told)
    distinct, met = dict.fromkeys(range(len(groups)), 0), {}
    for r in out.collect():
        holders = [p for j, p in enumerate(kinds[r.which]) if r.mask[j // WORD] >> j % WORD & 1]
        for p in holders:
            distinct[p] += r.n
        for a, b in combinations(holders, 2):
            met[a, b] = met[b, a] = met.get((a, b), 0) + r.n
    return distinct, met


def _least(tables, cols, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Of each pair of columns, the sum over the values of both of the rows that hold it in the one that has fewer."""
    groups, out = [(c,) for c in sorted({c for d in pairs for c in d})], None
    for places in _kinds(cols, groups):
        rows = None
        for t in sorted({cols[groups[p][0]][0] for p in places}):
            own = [c for p in places for c in groups[p] if cols[c][0] == t]
            part = tables[t].select(F.explode(F.array(*[F.struct(_value(cols[c][1], cols[c][4]).alias("v"), F.when(_present(cols, (c,)), F.lit(c)).alias("c")) for c in own])).alias("r")).select("r.*").filter("c IS NOT NULL")
            rows = part if rows is None else rows.unionAll(part)
        held = rows.groupBy("v", "c").agg(F.count("*").alias("n")).groupBy("v").agg(F.collect_list(F.struct("c", "n")).alias("held")).filter(F.size("held") > 1)
        told = held.select("held", F.explode("held").alias("a")).select("a", F.explode("held").alias("b")).groupBy(F.col("a.c").alias("f"), F.col("b.c").alias("k")).agg(F.sum(F.least("a.n", "b.n")).alias("n"))
        out = told if out is None else out.unionAll(told)
    return {(r.f, r.k): r.n for r in out.collect() if (r.f, r.k) in pairs}


def _narrowed(tables, cols, scoped, full, distinct) -> list[tuple]:
    """Those of ``scoped`` that may have half of their pairs of values in common, without counting the pairs of the side that is the key.

    No pair of values is in common more often than either of its values is in the rows of both sides. Where few pairs
    of values are to be found, the rows of the other side are held against these before any of them is shuffled.
    """
    ours = sorted({tuple(sorted((x[0], x[2]))) for x in scoped})
    size, _ = _held(tables, cols, ours)
    df = {x: size[p] for p, d in enumerate(ours) for x in (d, d[::-1])}
    scoped = [x for x in scoped if df[x[0], x[2]] > 0 and min(full[x[1], x[3]], distinct[x[1]] * distinct[x[3]]) >= 0.5 * df[x[0], x[2]]]
    if not scoped:
        return []
    least = _least(tables, cols, {d for x in scoped for d in ((x[0], x[1]), (x[2], x[3]))})
    scoped = [x for x in scoped if min(least.get((x[0], x[1]), 0), least.get((x[2], x[3]), 0)) / df[x[0], x[2]] >= 0.5]
    near = [x for x in scoped if df[x[0], x[2]] <= FEW_PAIRS]
    if not near:
        return scoped
    # of the pairs in both orders one is enough
    near = {x: x if x[0] < x[2] else (x[2], x[3], x[0], x[1]) for x in near}
    few = sorted({(x[0], x[2]) for x in near.values()})
    groups = sorted({*few, *((x[1], x[3]) for x in near.values())})
    _, common = _held(tables, cols, groups, few)
    at = {d: p for p, d in enumerate(groups)}
    return [x for x in scoped if x not in near or common.get((at[near[x][0], near[x][2]], at[near[x][1], near[x][3]]), 0) / df[x[0], x[2]] >= 0.5]


def _rescues(tables, cols, rows_of, filled, distinct, unique, met, anchors, admitted, label) -> list[tuple]:
    scoped = [(pf, pk, sf, sk) for pf, pk in anchors for sf, sk in admitted
              if cols[sf][0] == cols[pf][0] and cols[sk][0] == cols[pk][0] and cols[sf][1] != cols[pf][1] and cols[sk][1] != cols[pk][1] and not unique[sk]
              and distinct[pk] * distinct[sk] >= 0.9 * max(0, filled[pk] + filled[sk] - rows_of[cols[pk][0]])]
    # the same two pairs of columns in the other order have the same values in common
    meeting = lambda pf, pk, sf, sk: ((pf, sf), (pk, sk)) if pf < sf else ((sf, pf), (sk, pk))

    def duos() -> dict[tuple[int, int], int]:
        return {d: p for p, d in enumerate(sorted({d for x in scoped for d in meeting(*x)}))}

    if not (at := duos()):
        return []
    _, both = _filled(tables, cols, list(at))
    full = {x: both[p] for d, p in at.items() for x in (d, d[::-1])}
    scoped = [x for x in scoped if full[x[1], x[3]] > 0 and distinct[x[1]] * distinct[x[3]] >= 0.9 * full[x[1], x[3]]]
    if sum(full[d] for d in {(x[1], x[3]) for x in scoped}) > FEW_ROWS:
        scoped = _narrowed(tables, cols, scoped, full, distinct)
    if not (at := duos()):
        return []
    size, common = _held(tables, cols, list(at))
    many = {x: size[p] for d, p in at.items() for x in (d, d[::-1])}
    best: dict[tuple[int, int], tuple] = {}
    for pf, pk, sf, sk in scoped:
        from_filled, df, to_filled, dt = full[pf, sf], many[pf, sf], full[pk, sk], many[pk, sk]
        a, b = meeting(pf, pk, sf, sk)
        matched = common.get((at[a], at[b]), 0)
        if not (dt >= 2 and dt >= 0.9 * to_filled and df > 0 and dt >= 0.5 * df and dt > distinct[sk]) or matched / df < 0.5:
            continue
        order = (-met[sf, sk] / distinct[sf], sf, sk)
        if (pf, pk) not in best or order < best[pf, pk][0]:
            first = distinct[pk] >= distinct[sk]
            a, b = ((pf, pk), (sf, sk)) if first else ((sf, sk), (pf, pk))
            best[pf, pk] = (order, (1, min(pf, sf), max(pf, sf), label(a[0]), label(a[1]), _cardinality(df == from_filled, dt == to_filled), matched / df, matched, df - matched, df, dt, dt == to_filled, cols[a[1]][3], label(b[0]), label(b[1])))
    return sorted({r for _, r in best.values()})


def detect_relationships(candidates: DataFrame, top: int = 16) -> DataFrame:
    """The candidates in order of merit: unique targets that aren't dates, many-to-one, overlap, coverage of the key."""
    clean = F.when(F.col("to_unique") & ~F.col("to_temporal"), 0).otherwise(1)
    kind = F.when(F.col("cardinality") == "many-to-one", 0).when(F.col("cardinality") == "one-to-one", 1).otherwise(2)
    order = Window.orderBy(clean, kind, F.col("overlap").desc(), (F.col("matched") / F.col("to_distinct")).desc(), "seq")
    return candidates.filter("from_col IS NOT NULL").withColumn("place", F.row_number().over(order)).withColumn("in_summary", F.col("place") <= top)
