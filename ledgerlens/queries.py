"""The registered queries of the engine's own operators, over whole tables, and DuckDB SQL that gives the same results.

Doubles that come from sums are rounded, as their last bits depend on the order of addition.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import additivity, cells, derivation, detectors, hierarchy, loads, profiles, relationships, series

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _profile_sql(table: str, columns: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS total, CASE count(*) WHEN 0 THEN 0.0 ELSE 1.0 * (count(*) - count({c})) / count(*) END AS null_ratio, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi FROM {table}"
    return " UNION ALL ".join(f"SELECT \"column\", total, CAST(null_ratio AS DOUBLE) AS null_ratio, \"distinct\", lo AS \"min\", hi AS \"max\" FROM ({one(c)})" for c in columns)


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@_query(_profile_sql("lineitem", _LINEITEM))
def column_profile_lineitem(spark, sf_dir):
    return profiles.column_profile(_t(spark, sf_dir, "lineitem"))


@_query(_profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def column_profile_documents(spark, sf_dir):
    return profiles.column_profile(_t(spark, sf_dir, "documents"))


def _outlier_sql(table: str, columns: list[str]) -> str:
    one = lambda c: f"""
SELECT '{c}' AS "column", n > 0 AS applicable, n AS parsed, round(a, 6) AS lower, round(b, 6) AS upper, io AS iqr_count,
       round(io / n, 9) AS iqr_ratio, zo AS z_count, round(zo / n, 9) AS z_ratio
FROM (
  SELECT any_value(q.n) AS n, any_value(q.a) AS a, any_value(q.b) AS b,
         count(CASE WHEN t.{c} NOT BETWEEN q.a AND q.b THEN 1 END) AS io,
         count(CASE WHEN q.d > 0 AND 0.6745 * abs(t.{c} - q.m) / q.d > 3.5 THEN 1 END) AS zo
  FROM {table} t CROSS JOIN (
    SELECT count({c}) AS n, median({c}) AS m, mad({c}) AS d,
           2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75) AS a, 2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25) AS b
    FROM {table}) q)"""  # noqa: E731
    return " UNION ALL ".join(one(c) for c in columns)


_PRICES = ["l_quantity", "l_extendedprice", "l_discount"]


@_query(_outlier_sql("lineitem", _PRICES))
def outlier_profile_lineitem(spark, sf_dir):
    out = None
    for c in _PRICES:
        part = profiles.outlier_profile(_t(spark, sf_dir, "lineitem"), c).select(F.lit(c).alias("column"), "applicable", "parsed", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "iqr_count", F.round("iqr_ratio", 9).alias("iqr_ratio"), "z_count", F.round("z_ratio", 9).alias("z_ratio"))
        out = part if out is None else out.unionByName(part)
    return out


def _temporal_sql(table: str, column: str) -> str:
    return f"""
WITH s AS (SELECT DISTINCT {column} AS t, epoch({column}) AS e FROM {table} WHERE {column} IS NOT NULL),
g AS (SELECT * FROM (SELECT e, lead(e) OVER (ORDER BY e) - e AS gap FROM s) WHERE gap IS NOT NULL),
m AS (SELECT quantile_disc(gap, 0.5) AS med, min(gap) AS lo, max(gap) AS hi FROM g),
k AS (SELECT *, CASE WHEN med IS NULL THEN 'unknown' WHEN abs(med - 1) < 0.5 THEN 'second' WHEN abs(med - 60) < 5 THEN 'minute' WHEN abs(med - 3600) < 300 THEN 'hour'
  WHEN abs(med - 86400) < 3600 THEN 'day' WHEN abs(med - 604800) < 86400 THEN 'week' WHEN abs(med - 2592000) < 259200 THEN 'month'
  WHEN abs(med - 7776000) < 777600 THEN 'quarter' WHEN abs(med - 31536000) < 3153600 THEN 'year' ELSE 'irregular' END AS granularity FROM m),
b AS (SELECT CASE granularity WHEN 'second' THEN e WHEN 'minute' THEN floor(e / 60) WHEN 'hour' THEN floor(e / 3600) WHEN 'day' THEN floor(e / 86400)
  WHEN 'week' THEN floor((e + 259200) / 604800) WHEN 'month' THEN year(t) * 12 + month(t) WHEN 'quarter' THEN year(t) * 4 + quarter(t) WHEN 'year' THEN year(t) END AS b FROM s, k),
c AS (SELECT count(DISTINCT b) AS actual, CAST(max(b) - min(b) + 1 AS BIGINT) AS expected FROM b),
w AS (SELECT count(*) AS n, max(gap) / 86400.0 AS largest FROM g, k WHERE med > 0 AND gap > 2 * med)
SELECT true AS applicable, (SELECT round((max(e) - min(e)) / 86400.0, 9) FROM s) AS span_days, granularity,
  CAST(round(CASE WHEN med IS NULL THEN 0 WHEN granularity = 'irregular' THEN 0.3 WHEN lo > 0 THEN 1 - least((hi - lo) / med / 10, 0.5) ELSE 0.7 END, 9) AS DOUBLE) AS confidence,
  w.n AS gap_count, round(w.largest, 9) AS largest_days, CASE WHEN c.actual > 0 THEN c.expected END AS expected, nullif(c.actual, 0) AS actual
FROM k, c, w"""


def _temporal(df: DataFrame, column: str) -> DataFrame:
    return profiles.temporal_profile(df, column).select("applicable", F.round("span_days", 9).alias("span_days"), "granularity", F.round("confidence", 9).alias("confidence"), "gap_count", F.round("largest_days", 9).alias("largest_days"), "expected", "actual")


@_query(_temporal_sql("orders", "o_orderdate"))
def temporal_profile_orders(spark, sf_dir):
    return _temporal(_t(spark, sf_dir, "orders"), "o_orderdate")


@_query(_temporal_sql("events", "ts"))
def temporal_profile_events(spark, sf_dir):
    return _temporal(_t(spark, sf_dir, "events"), "ts")


def _cells_sql(tables: dict[str, list[tuple[str, str]]]) -> str:
    parts, ci = [], 0
    for table in sorted(tables):
        for c, kind in tables[table]:
            ci += 1
            parts.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", CAST({ci} AS BIGINT) AS ci, '{kind}' AS column_type, CAST({c} AS VARCHAR) AS val FROM {table}")
    return " UNION ALL ".join(parts)


@_query(_cells_sql({"nation": [("n_nationkey", "INTEGER"), ("n_name", "VARCHAR"), ("n_regionkey", "INTEGER")], "region": [("r_regionkey", "INTEGER"), ("r_name", "VARCHAR")]}))
def dataset_cells_nation(spark, sf_dir):
    return cells.dataset_cells(spark, {n: _t(spark, sf_dir, n) for n in ("nation", "region")}).drop("rn")


@_query("SELECT 'embeddings' AS \"table\", 'vec_id' AS \"column\", CAST(1 AS BIGINT) AS ci, 'BIGINT' AS column_type, CAST(vec_id AS VARCHAR) AS val FROM embeddings UNION ALL SELECT 'embeddings', 'label', 2, 'INTEGER', CAST(label AS VARCHAR) FROM embeddings")
def dataset_cells_nested(spark, sf_dir):
    return cells.dataset_cells(spark, {"embeddings": _t(spark, sf_dir, "embeddings")}).drop("rn")


@_query("SELECT table_name, column_name, data_type AS column_type, CAST(ordinal AS INTEGER) AS ordinal_position, 'BASE TABLE' AS table_type FROM (VALUES ('nation', 'n_nationkey', 'INTEGER', 1), ('nation', 'n_name', 'VARCHAR', 2), ('nation', 'n_regionkey', 'INTEGER', 3), ('region', 'r_regionkey', 'INTEGER', 1), ('region', 'r_name', 'VARCHAR', 2)) v(table_name, column_name, data_type, ordinal)")
def dataset_columns(spark, sf_dir):
    return cells.columns(spark, {n: _t(spark, sf_dir, n) for n in ("nation", "region")})


@_query("SELECT o_totalprice AS v FROM orders")
def subject_column_orders(spark, sf_dir):
    return cells.subject_column(_t(spark, sf_dir, "orders"), "o_totalprice")


def _check_sql(child: str, ck: str, parent: str, pk: str, name: str, dates: list[tuple[str, str]]) -> str:
    base = f"""
WITH c AS (SELECT CAST({ck} AS VARCHAR) AS k, * FROM {child} WHERE {ck} IS NOT NULL),
p AS (SELECT CAST({pk} AS VARCHAR) AS k, * FROM {parent} WHERE {pk} IS NOT NULL),
lost AS (SELECT k, count(*) AS n FROM c ANTI JOIN p USING (k) GROUP BY k),
e AS (SELECT (SELECT count(*) FROM c) AS filled, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM lost) AS orphans, (SELECT count(*) FROM lost) AS orphan_distinct,
  (SELECT coalesce(string_agg(k || '=' || n, ',' ORDER BY n DESC, k), '') FROM (SELECT * FROM lost ORDER BY n DESC, k LIMIT 3)) AS orphan_keys)"""
    pairs = " UNION ALL ".join(f"SELECT {i} AS pair_seq, '{a}' AS child_column, '{b}' AS parent_column, count(*) FILTER (c.{a} IS NOT NULL AND p.{b} IS NOT NULL) AS joined, count(*) FILTER (c.{a} < p.{b}) AS precedes FROM c JOIN p USING (k)" for i, (a, b) in enumerate(dates, 1))
    pairs = f"SELECT * FROM ({pairs}) WHERE joined > 0" if dates else "SELECT CAST(NULL AS BIGINT) AS pair_seq, CAST(NULL AS VARCHAR) AS child_column, CAST(NULL AS VARCHAR) AS parent_column, CAST(NULL AS BIGINT) AS joined, CAST(NULL AS BIGINT) AS precedes WHERE false"
    return f"""{base}
SELECT true AS applicable, '{name}' AS relationship, filled, orphans, CASE filled WHEN 0 THEN 0.0 ELSE orphans / filled END AS orphan_rate, orphan_keys, orphan_distinct,
  CAST(pair_seq AS BIGINT) AS pair_seq, child_column, parent_column, joined, precedes, precedes / joined AS precedes_rate
FROM e LEFT JOIN ({pairs}) d ON true"""


def _check(spark, child, ck, parent, pk, name):
    done = relationships.relationship_check(child, [ck], parent, [pk], name)
    keys = F.array_join(F.transform("orphan_keys", lambda k: F.concat(k["key"], F.lit("="), k["rows"].cast("string"))), ",")
    return done.withColumn("orphan_keys", keys).drop("reason", "seq")


@_query(_check_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem.l_orderkey -> orders.o_orderkey", [("l_shipdate", "o_orderdate")]))
def relationship_checks_lineitem_orders(spark, sf_dir):
    return _check(spark, _t(spark, sf_dir, "lineitem"), "l_orderkey", _t(spark, sf_dir, "orders"), "o_orderkey", "lineitem.l_orderkey -> orders.o_orderkey")


@_query(_check_sql("events", "user_id", "customer", "c_custkey", "events.user_id -> customer.c_custkey", []))
def relationship_checks_events_customer(spark, sf_dir):
    return _check(spark, _t(spark, sf_dir, "events"), "user_id", _t(spark, sf_dir, "customer"), "c_custkey", "events.user_id -> customer.c_custkey")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_SMALL = {"customer": [("c_custkey", "b"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "d"), ("c_mktsegment", "s")], "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")], "region": [("r_regionkey", "i"), ("r_name", "s")], "supplier": [("s_suppkey", "b"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "d")]}


def _candidates_sql() -> str:
    """No second columns of these tables hold each other's values, so none of their candidates has a composite key."""
    every = [(t, c, k) for t in sorted(_SMALL) for c, k in _SMALL[t]]
    vals = " UNION ALL ".join(f"SELECT {i} AS i, '{k}' AS kind, '{t}.{c}' AS label, CAST({c} AS VARCHAR) AS v FROM {t}" for i, (t, c, k) in enumerate(every))
    return f"""
WITH x AS ({vals}), u AS (SELECT DISTINCT i, kind, v FROM x WHERE v IS NOT NULL),
s AS (SELECT i, any_value(kind) AS kind, any_value(label) AS label, count(v) AS filled, count(DISTINCT v) AS d FROM x GROUP BY i),
m AS (SELECT a.i AS f, b.i AS k, count(*) AS n FROM u a JOIN u b ON a.v = b.v AND a.kind = b.kind AND a.i <> b.i GROUP BY a.i, b.i)
SELECT row_number() OVER (ORDER BY m.k, m.f) AS seq, f.label AS from_col, k.label AS to_col,
  CASE (CASE WHEN f.d = f.filled THEN 1 ELSE 0 END) + (CASE WHEN k.d = k.filled THEN 2 ELSE 0 END) WHEN 3 THEN 'one-to-one' WHEN 2 THEN 'many-to-one' WHEN 1 THEN 'one-to-many' ELSE 'many-to-many' END AS cardinality,
  m.n / f.d AS overlap, m.n AS matched, f.d - m.n AS orphans, f.d AS from_distinct, k.d AS to_distinct, k.d = k.filled AS to_unique, false AS to_temporal, CAST(NULL AS VARCHAR) AS kc_from, CAST(NULL AS VARCHAR) AS kc_to
FROM m JOIN s f ON f.i = m.f JOIN s k ON k.i = m.k
WHERE k.d >= 2 AND 2 * m.n >= f.d AND k.d >= 0.9 * k.filled"""


@_query(_candidates_sql())
def relationship_candidates_small(spark, sf_dir):
    return relationships.relationship_candidates(spark, {n: _t(spark, sf_dir, n) for n in _SMALL})


@_query()
def relationship_candidates_all(spark, sf_dir):
    """Every table and candidate, composite keys included; a test holds the operator against brute force."""
    return relationships.relationship_candidates(spark, {n: _t(spark, sf_dir, n) for n in _TABLES})


def _hierarchy_sql(table: str, columns: list[str]) -> str:
    """All columns given are in the pool."""
    parts = []
    order = 0
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            for f, t in ((a, b), (b, a)):
                order += 1
                best = lambda x, y: f"(SELECT sum(m) FROM (SELECT max(n) AS m FROM (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {table} GROUP BY 1, 2) GROUP BY x))"
                modal = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {t}))"
                groups = lambda x: f"(SELECT count(*) FROM (SELECT DISTINCT {x} FROM {table}))"
                parts.append(f"SELECT {order} AS seq, '{f}' AS from_col, '{t}' AS to_col, {groups(f)} AS distinct_from, {groups(t)} AS distinct_to, {groups(f'{f}, {t}')} AS pair_groups, {best(f, t)} AS agree, {best(t, f)} AS back, {modal} AS modal, (SELECT count(*) FROM {table}) AS n")
    return f"""
SELECT true AS applicable, n AS rows, CAST(seq AS BIGINT) AS seq, from_col, to_col, distinct_from, distinct_to, pair_groups, round((n - agree) / n, 9) AS g3, round((n - back) / n, 9) AS g3_reverse,
  round(CASE WHEN n = modal THEN 0 ELSE (agree - modal) / (n - modal) END, 9) AS gk_lambda, round(n / distinct_from, 9) AS rows_per_value
FROM ({" UNION ALL ".join(parts)})"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@_query(_hierarchy_sql("part", ["p_brand", "p_type", "p_size"]))
def hierarchy_part(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return _rounded(hierarchy.hierarchy_candidates(part, cells=None), "g3", "g3_reverse", "gk_lambda", "rows_per_value").drop("reason")


@_query(_hierarchy_sql("(SELECT n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)", ["n_name", "n_regionkey", "r_name"]))
def hierarchy_nation(spark, sf_dir):
    geo = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _rounded(hierarchy.hierarchy_candidates(geo.select("n_name", "n_regionkey", "r_name"), cells=None), "g3", "g3_reverse", "gk_lambda", "rows_per_value").drop("reason")


_DETECT = _hierarchy_sql("(SELECT n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)", ["n_name", "n_regionkey", "r_name"])


@_query(f"SELECT from_col, to_col, g3, gk_lambda, CASE WHEN g3 <= 0.01 AND g3_reverse <= 0.01 THEN 'alias' ELSE 'edge' END AS kind FROM ({_DETECT}) WHERE g3 <= 0.05")
def detect_hierarchies_nation(spark, sf_dir):
    return hierarchy.detect_hierarchies(hierarchy_nation(spark, sf_dir)).select("from_col", "to_col", "g3", "gk_lambda", "kind")


_LINES = "(SELECT l_quantity AS qty, l_extendedprice AS price, l_quantity * l_extendedprice AS amount, l_extendedprice * l_tax AS tax, l_extendedprice + l_extendedprice * l_tax + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS gross FROM lineitem)"
_TRIPLE = [("amount", "qty", "price", "*"), ("gross", "price", "tax", "+")]


@_query(" UNION ALL ".join(f"SELECT '{t}' AS target, '{'product' if op == '*' else 'sum'}' AS form, '{a}' AS operand_1, '{b}' AS operand_2, count(*) AS support, count(*) FILTER (abs({t} - ({a} {op} {b})) > greatest(0.011, abs({t}) / 1e6)) AS violations FROM {_LINES}" for t, a, b, op in _TRIPLE))
def derivation_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("amount"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), (F.col("l_extendedprice") + F.col("l_extendedprice") * F.col("l_tax") + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)).alias("gross"))
    return derivation.detect_derivations(derivation.derivation_candidates(lines, cells=None)).select("target", "form", "operand_1", "operand_2", "support", "violations")


@_query("""
SELECT * FROM (
  SELECT 'orders' AS "view", '' AS dimension, '' AS member, date_trunc('month', o_orderdate) AS period, round(sum(o_totalprice), 2) AS value, CAST(NULL AS DOUBLE) AS weight, count(*) AS rows FROM orders GROUP BY 4
  UNION ALL SELECT 'orders', 'o_orderstatus', o_orderstatus, date_trunc('month', o_orderdate), round(sum(o_totalprice), 2), round(sum(abs(o_totalprice)), 2), count(*) FROM orders GROUP BY 3, 4
  UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority, date_trunc('month', o_orderdate), round(sum(o_totalprice), 2), round(sum(abs(o_totalprice)), 2), count(*) FROM orders GROUP BY 3, 4)""")
def series_monthly_revenue(spark, sf_dir):
    axes = series.Axes("orders", "o_orderdate", "o_totalprice", "month", dimensions=("o_orderstatus", "o_orderpriority"))
    done = series.series_aggregate(spark, {"orders": _t(spark, sf_dir, "orders")}, [axes])
    return done.select("view", "dimension", "member", "period", F.round("value", 2).alias("value"), F.round("weight", 2).alias("weight"), "rows")


@_query("SELECT date_trunc('quarter', l_shipdate) AS period, round(sum(l_extendedprice * l_discount), 2) AS num, round(sum(l_extendedprice), 2) AS den, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS ratio, count(*) AS rows FROM lineitem GROUP BY 1")
def series_ratio_discount(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumn("given", F.col("l_extendedprice") * F.col("l_discount"))
    done = series.series_aggregate(spark, {"lines": lines}, [series.Axes("lines", "l_shipdate", "given", "quarter", num="given", den="l_extendedprice")])
    return done.select("period", F.round("num", 2).alias("num"), F.round("den", 2).alias("den"), F.round(F.col("num") / F.col("den"), 9).alias("ratio"), "rows")


@_query("SELECT period, value FROM (SELECT date_trunc('month', ts) AS period, arg_max(value, ts) AS value FROM events GROUP BY 1)")
def series_last_level(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return series.folded(ev, "ts", "value", additivity="semi-additive").select("period", "value")


@_query("SELECT string_agg(m || '=' || v, ';' ORDER BY m) AS fingerprint, count(*) AS months FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, CAST(CAST(count(*) AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM orders GROUP BY 1)")
def collision_fingerprint(spark, sf_dir):
    return series.fingerprint(_t(spark, sf_dir, "orders").withColumn("one", F.lit(1)), period="o_orderdate", value="one")


@_query("SELECT CAST(3 AS BIGINT) AS definitions, kind, properties FROM (VALUES ('served_series', 'by_case,by_filter'), ('sql', 'by_filter,by_filter_again')) v(kind, properties)")
def definition_collisions(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    sql = {
        "by_filter": "SELECT date_trunc('month', o_orderdate) AS period, count(*) AS value FROM _orders WHERE o_orderstatus = 'F' GROUP BY 1",
        "by_filter_again": "select   date_trunc('month', o_orderdate) as period, COUNT(*) as value from _orders where o_orderstatus = 'F' group by 1",
        "by_case": "SELECT date_trunc('month', o_orderdate) AS period, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS value FROM _orders GROUP BY 1 HAVING value > 0",
    }
    views = {n: spark.sql(s) for n, s in sql.items()}
    found = series.definition_collisions(spark, [{"property": n, "subject": "sales", "flavor": "metric", "sql": s} for n, s in sql.items()], {n: views[n] for n in ("by_filter", "by_case")})
    return found.select("definitions", "kind", F.array_join("properties", ",").alias("properties"))


@_query("""
WITH r AS (SELECT doc_id, v FROM (SELECT doc_id, CAST(quality AS VARCHAR) AS v FROM labels UNION ALL SELECT doc_id, CAST(toxic AS VARCHAR) FROM labels)),
s AS (SELECT doc_id, CASE count(*) WHEN 1 THEN 0.0 ELSE (count(DISTINCT v) - 1.0) / (count(*) - 1) END AS score FROM r GROUP BY doc_id)
SELECT doc_id AS subject, CASE WHEN score = 0 THEN 'green' WHEN score <= 0.7 THEN 'yellow' ELSE 'red' END AS state, CAST(score AS DOUBLE) AS score FROM s""")
def value_entropy_labels(spark, sf_dir):
    lab = _t(spark, sf_dir, "labels")
    said = lab.select("doc_id", F.explode(F.array("quality", "toxic")).alias("v")).select(F.col("doc_id").alias("subject"), F.to_json(F.struct(F.col("v").alias("value"))).alias("body"))
    return detectors.value_entropy(said, 0.7)


@_query("""
SELECT o_orderpriority AS subject, CASE WHEN rate <= 0.1 THEN 'green' ELSE 'red' END AS state, CASE WHEN rate <= 0.1 THEN 0.0 ELSE rate END AS score
FROM (SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1)""")
def rate_tolerance_orders(spark, sf_dir):
    rate = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "P").cast("double")), 6).alias("r"))
    checks = rate.select(F.col("o_orderpriority").alias("subject"), F.lit("function").alias("actor_kind"), F.to_json(F.struct(F.col("r").alias("breach_rate"))).alias("body"))
    claims = rate.select(F.col("o_orderpriority").alias("subject"), F.lit("agent").alias("actor_kind"), F.lit('{"tolerance": 0.1}').alias("body"))
    return detectors.rate_tolerance(checks.unionByName(claims)).withColumn("score", F.round("score", 6))


_VOTES = """
WITH f AS (SELECT n_nationkey AS entity, date_trunc('month', o_orderdate) AS b, sum(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
s AS (SELECT *, sum(m) OVER (PARTITION BY entity ORDER BY b) AS y FROM f),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY entity ORDER BY b) AS dy FROM s)
SELECT CAST(entity AS VARCHAR) AS entity, count(*) AS n, round(sum(abs(y - m)) / sum(abs(m)), 6) AS r_flow, round(sum(abs(dy - m)) / sum(abs(m)) FILTER (dy IS NOT NULL), 6) AS r_stock,
  CASE WHEN count(*) < 4 THEN NULL ELSE 'semi-additive' END AS vote
FROM d GROUP BY entity"""


@_query(_VOTES)
def additivity_votes(spark, sf_dir):
    met = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    flow = met.groupBy(F.col("c_nationkey").cast("string").alias("entity"), F.date_trunc("month", "o_orderdate").alias("b")).agg(F.sum("o_totalprice").alias("m"))
    stock = flow.withColumn("y", F.sum("m").over(Window.partitionBy("entity").orderBy("b")))
    return additivity.votes(stock, ["entity"]).select("entity", "n", F.round("r_flow", 6).alias("r_flow"), F.abs(F.round("r_stock", 6)).alias("r_stock"), "vote")


@_query("SELECT s, n, round(CASE WHEN n = 0 THEN 0 ELSE (s / n + 1.9208 / n - 1.96 * sqrt(s / n * (1 - s / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n) END, 9) AS bound FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1)")
def wilson_bounds(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("s"), F.count("*").alias("n"))
    return n.select("s", "n", F.round(additivity.wilson_lower(F.col("s"), F.col("n")), 9).alias("bound"))


@_query("""
WITH fresh AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey, 'N', 0.0 FROM orders WHERE o_orderkey % 100 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) o FULL JOIN fresh n ON n.o_orderkey = o.o_orderkey""")
def keyed_merge_orders(spark, sf_dir):
    old = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = old.filter("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = old.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return loads.merged(old, changed.unionByName(added), ["o_orderkey"])[0]


@_query("SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1")
def duplicate_keys_lineitem(spark, sf_dir):
    return loads.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey"]).withColumnRenamed("rows", "n")


def _balances(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A running total per nation and month, and the orders that move it, as additivity cells hold them."""
    met = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = met.groupBy(F.col("c_nationkey").cast("string").alias("entity"), F.date_trunc("day", "o_orderdate").alias("period")).agg(F.sum("o_totalprice").alias("value"))
    month = day.groupBy("entity", F.date_trunc("month", "period").alias("period")).agg(F.sum("value").alias("m"))
    return day, month.select("entity", "period", F.sum("m").over(Window.partitionBy("entity").orderBy("period")).alias("value"))


def _anchors(spark, sf_dir) -> DataFrame:
    day, stock = _balances(spark, sf_dir)
    kind = "side string, event string, align string, measure_align string, axis string, term string, identifier boolean, entity string, period timestamp, value double, reason string"

    def piece(df, **fixed):
        names = [p.split(" ") for p in kind.split(", ")]
        return df.select(*[(F.lit(fixed[n]) if n in fixed else F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])

    made = piece(stock, side="measure", align="nation", axis="month").unionByName(piece(day, side="event", event="orders", align="nation", axis="day", term="o_totalprice"))
    made = made.unionByName(piece(spark.range(1), side="alignment", event="orders", align="nation", measure_align="nation", axis="day"))
    return additivity.additivity_anchors(made)


@_query("""
WITH f AS (SELECT c_nationkey AS e, date_trunc('month', o_orderdate) AS b, sum(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT *, sum(m) OVER (PARTITION BY e ORDER BY b) AS y FROM f),
r AS (SELECT e, sum(abs(y - m)) / sum(m) AS r_flow FROM s GROUP BY e)
SELECT 'orders' AS event, 'month' AS grain, 'none' AS scope, count(*) AS entities, count(*) AS viable_entities, 'semi-additive' AS result, 'o_totalprice' AS convention, count(*) AS voted,
  1.0::DOUBLE AS agreement, round((1 + 1.9208 / count(*) - 1.96 * sqrt(0.9604) / count(*)) / (1 + 3.8416 / count(*)), 6) AS support, round(median(r_flow), 4) AS r_flow
FROM r""")
def additivity_anchors_orders(spark, sf_dir):
    found = _anchors(spark, sf_dir).filter("grain = 'month' AND scope = 'none' AND convention <> 'monotone'")
    return found.select("event", "grain", "scope", "entities", "viable_entities", "result", "convention", "voted", "agreement", F.round("support", 6).alias("support"), F.round("r_flow", 4).alias("r_flow"))


@_query()
def additivity_anchors_all(spark, sf_dir):
    """Every anchor of the same cells; a test holds votes, results and support of those by grain and scope against brute force."""
    return _anchors(spark, sf_dir)


def _workspace(spark, sf_dir):
    """A workspace over the nation and region tables, made for one query."""
    from . import kits
    from .catalog.workspace import Workspace

    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base.removeprefix("file://") if base and (base.startswith("/") or base.startswith("file:/")) else tempfile.gettempdir()
    name = f"q_{uuid.uuid4().hex[:10]}"
    ws = Workspace(spark, f"{base}/ledgerlens-ws/{name}")
    ws.execute(f"DECLARE SOURCE files SET (type: parquet, location: '{sf_dir}'); DECLARE DATASET {name} SET (purpose: 'query'); USE {name};" + "".join(f"DECLARE RECIPE {t} ON {name} FROM files AS $$SELECT * FROM read_parquet('{t}.parquet')$$;" for t in ("nation", "region")))
    kits.load(ws, "kpi", "quality")
    return ws, name


@_query(" UNION ALL ".join(f"SELECT 'nation.{c}' AS subject, CAST(count(*) AS BIGINT) AS total, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS least FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))
def workspace_extraction_nation(spark, sf_dir):
    ws, name = _workspace(spark, sf_dir)
    got = ws.sql("SELECT column_profile() FROM nation")
    number = lambda k: F.get_json_object("value", f"$.{k}").cast("long")
    return got.select(F.substring_index("subject", ".", -2).alias("subject"), number("total").alias("total"), number("distinct").alias("distinct_values"), F.get_json_object("value", "$.min").alias("least"))


@_query("SELECT * FROM (VALUES ('nation', 'entity', 'missing'), ('nation', 'meaning', 'current'), ('nation.n_name', 'meaning', 'missing'), ('nation.n_name', 'role', 'current'), ('nation.n_name', 'dimension', 'missing'), ('nation.n_nationkey', 'meaning', 'missing'), ('nation.n_nationkey', 'role', 'missing'), ('nation.n_regionkey', 'meaning', 'missing'), ('nation.n_regionkey', 'role', 'missing')) v(subject, property, state)")
def workspace_glossary_nation(spark, sf_dir):
    ws, name = _workspace(spark, sf_dir)
    ws.execute("GLOSS meaning ON nation AS $${\"value\": \"countries\"}$$; GLOSS role ON nation.n_name AS $${\"value\": \"dimension\"}$$")
    return ws.sql("SELECT * FROM GLOSSARY(nation)").select(F.expr(f"substring(subject, {len(name) + 2})").alias("subject"), "property", "state")


@_query("SELECT 'nation.n_name' AS subject, 'role_test' AS test, 'red' AS state, 1.0::DOUBLE AS score, true AS current")
def workspace_tests_nation(spark, sf_dir):
    from .catalog.workspace import Workspace

    ws, name = _workspace(spark, sf_dir)
    ws.sql("GLOSS role ON nation.n_name AS $${\"value\": \"dimension\"}$$")
    human = Workspace(spark, ws.path, actor="human")
    human.execute(f"USE {name}; GLOSS role ON nation.n_name AS $${{\"value\": \"key\"}}$$; SELECT role_test() FROM nation")
    return human.sql("SELECT * FROM TESTS(nation)").select(F.expr(f"substring(subject, {len(name) + 2})").alias("subject"), "test", "state", "score", "current")


@_query("SELECT * FROM (VALUES ('column_profile', 'nation.n_name', 'data', 'changed'), ('column_profile', 'nation.n_nationkey', 'data', 'changed'), ('column_profile', 'nation.n_regionkey', 'data', 'changed')) v(function, subject, what, reason)")
def workspace_outdated_nation(spark, sf_dir):
    ws, name = _workspace(spark, sf_dir)
    ws.execute("SELECT column_profile() FROM nation; IMPORT nation")
    return ws.sql("SELECT * FROM outdated()").select("function", F.expr(f"substring(subject, {len(name) + 2})").alias("subject"), "what", "reason")


@_query("SELECT true AS applicable, count(*) AS filled, CAST(0 AS BIGINT) AS orphans, 0.0::DOUBLE AS orphan_rate FROM nation JOIN region ON n_regionkey = r_regionkey")
def workspace_relationship_coherence(spark, sf_dir):
    ws, _ = _workspace(spark, sf_dir)
    ws.sql("DECLARE RELATIONSHIP nation.n_regionkey -> region.r_regionkey")
    got = ws.sql("SELECT relationship_coherence() FROM nation.n_regionkey -> region.r_regionkey")
    value = lambda k, t: F.get_json_object("value", f"$.{k}").cast(t).alias(k)
    return got.select(value("applicable", "boolean"), value("filled", "long"), value("orphans", "long"), value("orphan_rate", "double"))


@_query("SELECT * FROM (VALUES ('r_name', 'region.r_name', NULL), ('nations', 'nation.n_nationkey', NULL), ('share', 'nation.n_nationkey', 'ratio')) v(\"column\", source, shape)")
def workspace_view_lineage(spark, sf_dir):
    ws, name = _workspace(spark, sf_dir)
    ws.sql(f"GLOSS by_region ON {name} AS $${{\"kind\": \"table\", \"sql\": \"SELECT r_name, count(n_nationkey) AS nations, sum(n_nationkey) / count(n_nationkey) AS share FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name\"}}$$")
    told = ws.sql(f"SELECT * FROM views_mapping('{name}') m").join(ws.sql(f"SELECT * FROM views_lineage('{name}') l").select("column", "shape"), "column").join(ws.sql("SELECT lineage() FROM by_region").select("function"))
    return told.select("column", F.expr(f"substring(source, {len(name) + 2})").alias("source"), "shape")


@_query("SELECT doc_id, CASE WHEN quality > 0 THEN '$.quality: must be at most 0' END AS failure FROM labels")
def json_schema_checks_labels(spark, sf_dir):
    from .catalog import jsonschema

    jsonschema.register(spark)
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("body"))
    schema = '{"type": "object", "required": ["quality"], "properties": {"quality": {"type": "integer", "maximum": 0}}}'
    return rows.select("doc_id", F.call_function("json_schema_check", F.lit(schema), "body").alias("failure"))


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS sum_value FROM events GROUP BY 1, 2")
def windowed_sums_events(spark, sf_dir):
    from .streaming import merge

    return merge.windowed(_t(spark, sf_dir, "events"), "ts", ["event_type"], ["value"], length="1 hour").withColumn("sum_value", F.round("sum_value", 6))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
