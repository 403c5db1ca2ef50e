"""The kits: vocabularies and measurements as declaration scripts, built here from small tables."""

from __future__ import annotations

import json


def _obj(required: list[str] | None = None, **props) -> dict:
    return {"type": "object"} | ({"required": required} if required else {}) | {"properties": props}


def _or_null(kind: str) -> dict:
    return {"type": [kind, "null"]}


_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "number"}, {"type": "boolean"}


def _property(name: str, schema: dict, kind: str, grains: str = "", when: str = "") -> str:
    on = f" ON {grains}" if grains else ""
    return f"DECLARE PROPERTY {name} WITH $${json.dumps(schema)}$$ AS {kind}{on}{' WHEN ' + when if when else ''};"


def _function(name: str, body: str, returns: str = "") -> str:
    return f"DECLARE FUNCTION {name} FOR GLOBAL AS $$\n{body.strip()}\n$${' RETURNS ' + returns if returns else ''};"


def _words(**allowed) -> dict:
    return _obj(["value"], **allowed)


def kpi() -> str:
    """What an analyst must be told about tables and columns, and profiles of columns."""
    measures = "role = 'measure'"
    return "\n".join([
        _property("meaning", _words(value=_TEXT), "FACT", "TABLE, COLUMN, RELATIONSHIP"),
        _property("role", _words(value={"enum": ["key", "measure", "dimension", "timestamp", "attribute"]}), "FACT", "COLUMN"),
        _property("additivity", _words(value={"enum": ["semi-additive", "additive", "ratio", "non-additive"]}, numerator=_TEXT, denominator=_TEXT, basis=_TEXT), "FACT", "COLUMN", measures),
        _property("unit", _words(value=_TEXT, source_column=_TEXT), "FACT", "COLUMN", measures),
        _property("dimension", _words(value={"enum": ["primary", "supporting", "none"]}), "FACT", "COLUMN", "role = 'dimension'"),
        _property("entity", _words(value=_TEXT, role={"enum": ["fact", "dimension"]}, grain={"type": "array", "items": _TEXT}, time_axis=_TEXT, identity_columns={"type": "array", "items": _TEXT}), "FACT", "TABLE"),
        _property("conventions", {"type": "object"}, "FACT", "SOURCE"),
        _function("value_entropy", """
            SELECT subject, CASE WHEN score = 0 THEN 'green' WHEN score <= coalesce($threshold, 1) THEN 'yellow' ELSE 'red' END AS state, score
            FROM (SELECT subject, CASE WHEN count(*) = 1 THEN 0D ELSE (count(DISTINCT get_json_object(body, '$.value')) - 1) / (count(*) - 1) END AS score
                  FROM annotations GROUP BY subject)"""),
        _property("column_profile", _obj(["total", "null_ratio", "distinct"], total={"type": "integer"}, null_ratio=_NUMBER, distinct={"type": "integer"}, min={}, max={}), "MEASUREMENT", "COLUMN"),
        _function("column_profile", "SELECT total, null_ratio, `distinct`, min, max FROM column_profile_of($subject)", "column_profile"),
        _property("outlier_profile", _obj(["applicable"], applicable=_FLAG, iqr={}, zscore={}), "MEASUREMENT", "COLUMN"),
        _function("outlier_profile", """
            SELECT applicable, CASE WHEN applicable THEN named_struct('lower', lower, 'upper', upper, 'count', iqr_count, 'ratio', iqr_ratio) END AS iqr,
                   CASE WHEN applicable THEN named_struct('count', z_count, 'ratio', z_ratio) END AS zscore
            FROM outlier_profile_of($subject)""", "outlier_profile"),
        "DECLARE TEST meaning_test ON meaning BY (AGENT, HUMAN);",
        "DECLARE TEST entity_test ON entity BY (AGENT, HUMAN);",
        *[f"DECLARE TEST {p}_test ON {p} BY (AGENT, HUMAN) DETECTOR value_entropy THRESHOLD 0.7;" for p in ("role", "additivity", "unit")],
        "DECLARE TEST dimension_test ON dimension BY (AGENT, HUMAN);",
    ])


def quality() -> str:
    """What the data is like and how it holds together; loaded after the kpi kit."""
    items = lambda **props: {"type": ["array", "null"], "items": _obj(**props)}
    return "\n".join([
        _property("hierarchy_candidates", _obj(["applicable"], applicable=_FLAG, rows=_or_null("integer"), candidates=items(**{"from": _TEXT, "to": _TEXT, "g3": _NUMBER, "kind": {"enum": ["edge", "alias"]}, "lambda": _NUMBER})), "MEASUREMENT", "TABLE"),
        _function("detect_hierarchies", """
            SELECT bool_and(applicable) AS applicable, min(reason) AS reason, max(rows) AS rows,
                   CASE WHEN bool_and(applicable) THEN transform(array_sort(collect_list(CASE WHEN g3 <= 0.05 THEN struct(seq, named_struct('from', from_col, 'to', to_col,
                     'distinct_from', distinct_from, 'distinct_to', distinct_to, 'pair_groups', pair_groups, 'g3', g3, 'lambda', gk_lambda, 'rows_per_value', rows_per_value,
                     'kind', CASE WHEN greatest(g3, g3_reverse) <= 0.01 THEN 'alias' ELSE 'edge' END) AS c) END)), x -> x.c) END AS candidates
            FROM hierarchy_candidates($subject)""", "hierarchy_candidates"),
        _property("relationship_candidates", _obj(candidates={"type": "array", "items": _obj(**{"from": _TEXT, "to": _TEXT, "cardinality": _TEXT, "overlap": _NUMBER})}, summary={"type": "object"}), "MEASUREMENT", "DATASET"),
        _function("detect_relationships", """
            WITH found AS (
              SELECT struct(CASE WHEN to_unique AND NOT to_temporal THEN 0 ELSE 1 END AS a, CASE cardinality WHEN 'many-to-one' THEN 0 WHEN 'one-to-one' THEN 1 ELSE 2 END AS b,
                       -overlap AS o, -matched / to_distinct AS m, seq) AS merit,
                     named_struct('from', from_col, 'to', to_col, 'cardinality', cardinality, 'overlap', overlap, 'matched', matched, 'orphans', orphans,
                       'from_distinct', from_distinct, 'to_distinct', to_distinct, 'to_unique', to_unique, 'to_temporal', to_temporal,
                       'key_columns', CASE WHEN kc_from IS NOT NULL THEN array(named_struct('from', kc_from, 'to', kc_to)) END) AS c
              FROM relationship_candidates($subject) WHERE from_col IS NOT NULL),
            listed AS (SELECT transform(array_sort(collect_list(struct(merit, c))), x -> x.c) AS candidates FROM found)
            SELECT candidates, named_struct('candidates', size(candidates), 'top', slice(candidates, 1, 16), 'note', 'the best sixteen; all of them read back as the stored value') AS summary FROM listed""", "relationship_candidates"),
        _property("relationship_coherence", _obj(["applicable"], applicable=_FLAG, reason=_or_null("string"), relationship=_or_null("string"), filled=_or_null("integer"), orphans=_or_null("integer"), orphan_rate=_or_null("number"), orphan_keys=items(key=_TEXT, rows={"type": "integer"}), orphan_distinct=_or_null("integer"), temporal=items(child_column=_TEXT, parent_column=_TEXT, joined={"type": "integer"}, precedes={"type": "integer"}, precedes_rate=_NUMBER)), "MEASUREMENT", "RELATIONSHIP"),
        _function("relationship_coherence", """
            SELECT applicable, reason, relationship, filled, orphans, orphan_rate, orphan_keys, orphan_distinct,
                   CASE WHEN applicable THEN transform(array_sort(collect_list(CASE WHEN child_column IS NOT NULL THEN struct(pair_seq, named_struct('child_column', child_column,
                     'parent_column', parent_column, 'joined', joined, 'precedes', precedes, 'precedes_rate', precedes_rate) AS c) END)), x -> x.c) END AS temporal
            FROM relationship_checks($subject) GROUP BY ALL""", "relationship_coherence"),
        _property("derivation_candidates", _obj(["applicable"], applicable=_FLAG, rows=_or_null("integer"), truncated=_or_null("boolean"), candidates=items(target=_TEXT, form={"enum": ["product", "sum"]}, operands={"type": "array", "items": _TEXT}, support={"type": "integer"}, violations={"type": "integer"}, match_rate=_NUMBER)), "MEASUREMENT", "TABLE"),
        _function("detect_derivations", """
            SELECT bool_and(applicable) AS applicable, min(reason) AS reason, max(rows) AS rows, bool_or(truncated) AS truncated,
                   CASE WHEN bool_and(applicable) THEN transform(array_sort(collect_list(CASE WHEN match_rate >= 0.95 AND support >= 20 THEN struct(-match_rate AS r, seq,
                     named_struct('target', target, 'form', form, 'operands', array(operand_1, operand_2), 'support', support, 'violations', violations, 'match_rate', match_rate) AS c) END)), x -> x.c) END AS candidates
            FROM derivation_candidates($subject)""", "derivation_candidates"),
        _property("definition_collisions", _obj(["applicable"], applicable=_FLAG, definitions={"type": "integer"}, collisions={"type": "array", "items": _obj(sql=_TEXT, properties={"type": "array", "items": _TEXT}, subjects={"type": "array", "items": _TEXT})}), "MEASUREMENT", "DATASET"),
        _function("detect_definition_collisions", """
            SELECT max(definitions) > 0 AS applicable, max(definitions) AS definitions,
                   transform(array_sort(collect_list(CASE WHEN kind IS NOT NULL THEN struct(seq, named_struct('kind', kind, 'sql', sql, 'months', months, 'properties', properties, 'subjects', subjects) AS c) END)), x -> x.c) AS collisions
            FROM definition_collisions($subject)""", "definition_collisions"),
        _property("additivity_evidence", _obj(["applicable"], applicable=_FLAG, reason=_or_null("string"), anchors_n=_or_null("integer"), decided=_or_null("integer"), summary={"type": ["object", "null"]}, anchors={"type": ["array", "null"]}), "MEASUREMENT", "COLUMN", "role = 'measure'"),
        _function("additivity_evidence", """
            WITH a AS (SELECT *, coalesce(convention = 'monotone', false) AS mono FROM additivity_anchors($subject)),
            ranked AS (SELECT *, row_number() OVER (ORDER BY round(support, 8) DESC, mono, voted DESC, event, align) AS place FROM a WHERE applicable AND result <> 'abstain'),
            best AS (SELECT * FROM ranked WHERE place = 1), second AS (SELECT * FROM ranked WHERE place = 2),
            quiet AS (SELECT reason FROM a WHERE applicable ORDER BY mono, entities IS NULL, voted DESC NULLS LAST, seq LIMIT 1),
            elected AS (
              SELECT named_struct('result', coalesce(b.result, 'abstain'), 'event', b.event, 'align', b.align, 'grain', b.grain, 'scope', b.scope, 'convention', b.convention, 'support', b.support,
                       'voted', b.voted, 'r_flow', b.r_flow, 'r_stock', b.r_stock,
                       'sign', CASE WHEN b.sign_primary IS NOT NULL THEN named_struct('primary', b.sign_primary, 'mirror', b.sign_mirror, 'both', b.sign_both) END,
                       'tiebreak', CASE WHEN abs(b.support - s.support) <= 1e-9 THEN CASE WHEN b.mono <> s.mono THEN 'reconciliation-over-monotone' WHEN b.voted <> s.voted THEN 'voted' ELSE 'event-name' END END,
                       'reason', CASE WHEN b.result IS NULL THEN q.reason END) AS summary
              FROM (SELECT 1) one LEFT JOIN best b ON true LEFT JOIN second s ON true LEFT JOIN quiet q ON true),
            listed AS (
              SELECT bool_and(applicable) AS applicable, min(CASE WHEN NOT applicable THEN reason END) AS reason, count(*) AS n, count(CASE WHEN result <> 'abstain' THEN 1 END) AS decided,
                     transform(array_sort(collect_list(struct(seq, struct(seq, event, align, measure_time, event_time, grain, scope, entities, viable_entities, identifier_columns, result, convention, voted,
                       agreement, support, r_flow, r_stock, sign_primary, sign_mirror, sign_both, alternatives, reason) AS c))), x -> x.c) AS anchors FROM a)
            SELECT applicable, reason, CASE WHEN applicable THEN n END AS anchors_n, CASE WHEN applicable THEN decided END AS decided,
                   CASE WHEN applicable THEN summary END AS summary, CASE WHEN applicable THEN anchors END AS anchors FROM listed CROSS JOIN elected""", "additivity_evidence"),
        _property("temporal_profile", _obj(["applicable"], applicable=_FLAG, granularity=_or_null("string"), confidence=_or_null("number"), completeness=_or_null("object"), gaps=_or_null("object")), "MEASUREMENT", "COLUMN", "role = 'timestamp'"),
        _function("temporal", """
            SELECT applicable, reason, min, max, span_days, granularity, confidence,
                   CASE WHEN applicable THEN named_struct('count', gap_count, 'largest_days', largest_days, 'sample', gap_sample) END AS gaps,
                   CASE WHEN expected IS NOT NULL THEN named_struct('expected', expected, 'actual', actual, 'ratio', ratio) END AS completeness
            FROM temporal_profile_of($subject)""", "temporal_profile"),
        _function("rate_tolerance", """
            SELECT subject, CASE WHEN rate IS NULL THEN 'yellow' WHEN rate <= allowed THEN 'green' ELSE 'red' END AS state, CASE WHEN rate > allowed THEN least(greatest(rate, 0D), 1D) ELSE 0D END AS score
            FROM (SELECT subject, max(CASE WHEN actor_kind = 'function' THEN try_cast(get_json_object(body, '$.breach_rate') AS DOUBLE) END) AS rate,
                    coalesce(max(CASE WHEN actor_kind = 'human' THEN try_cast(get_json_object(body, '$.tolerance') AS DOUBLE) END),
                             max(CASE WHEN actor_kind = 'agent' THEN try_cast(get_json_object(body, '$.tolerance') AS DOUBLE) END), $threshold, 0D) AS allowed
                  FROM annotations GROUP BY subject)"""),
    ])


def spatial() -> str:
    """Words and a profile for columns of geometries, held as well-known binary."""
    geometry = "TYPE IN ('GEOMETRY', 'BLOB')"
    return "\n".join([
        _property("shape", _words(value={"enum": ["point", "line", "polygon", "mixed"]}), "FACT", "COLUMN", geometry),
        _property("crs", _words(value=_TEXT, unit=_TEXT), "FACT", "COLUMN", geometry),
        _property("geometry_profile", _obj(["total"], total={"type": "integer"}, null_ratio=_NUMBER, kinds={}, invalid={"type": "integer"}, empty={"type": "integer"}, extent={}, area_sum=_or_null("number")), "MEASUREMENT", "COLUMN"),
        _function("geometry_profile", "SELECT * FROM geometry_profile_of($subject)", "geometry_profile"),
        "DECLARE TEST shape_test ON shape BY (AGENT, HUMAN);",
        "DECLARE TEST crs_test ON crs BY (AGENT, HUMAN);",
    ])


KITS = {"kpi": kpi, "quality": quality, "spatial": spatial}


def load(ws, *names: str) -> None:
    """Loads kits by name, each after those it builds on."""
    for name in names or KITS:
        ws.kit(KITS[name](), name, f"ledgerlens.kits.{name}")
