"""Reads of a workspace: GLOSSARY and TESTS, places and the read functions, the table functions of bodies and queries."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.types import base_type
from ..operators import additivity, cells, derivation, hierarchy, profiles, relationships, series
from ..plans.lineage import lineage as plan_lineage
from ..plans.lineage import relations_of
from . import axes as additivity_axes
from .language import LanguageError, Path, Token, subject_of, tokens
from .staleness import Check, Marks
from .store import RELATIONS
from .subjects import Subject, match, parse_side, split

PLACES = ("itself", "its columns", "its sources", "the columns it joins on", "its relationships", "its source systems", "its dataset", "the dataset's metrics", "the dataset's single values", "the dataset")
RANK = {"human": 0, "agent": 1, "function": 2}
READ_FUNCTIONS = ("annotations", "results", "definition")
#: Table functions that read no more than their arguments.
FREE = {"range", "explode", "explode_outer", "posexplode", "inline", "stack", "json_tuple", "sequence"}
_AGGREGATE = r"'(?:count|sum|avg|mean|max|min|median|stddev|variance|any_value|first|last|max_by|min_by|collect_list|collect_set|bool_and|bool_or|percentile\w*)\("


def is_pair(path: str) -> bool:
    return " -> " in path or " <-> " in path


def sides(path: str) -> tuple[str, str, str]:
    left, op, right = re.split(r" (<?->) ", path)
    return left, op, right


def grain_of(path: str, sources: set[str] = frozenset()) -> str:
    if is_pair(path):
        return "RELATIONSHIP"
    if path in sources:
        return "SOURCE"
    return ("DATASET", "TABLE", "COLUMN")[min(path.count("."), 2)]


class Reads:
    # -- kinds of assets that kits declare

    def register_kind(self, kind: str, assets=None, edges=None, places=None) -> None:
        """A kind of assets: functions of a dataset that give (asset, node_asset, node_what), (from, to, kind) and
        (subject or None, where, asset)."""
        self.kinds[kind] = {"assets": assets, "edges": edges, "places": places}

    def kind_rows(self, what: str, ds: str) -> list[tuple]:
        return [(*row, kind) if what == "assets" else row for kind, f in sorted(self.kinds.items()) if f[what] for row in f[what](ds)]

    def kind_asset(self, path: str) -> str | None:
        return next((r[3] for r in self.kind_rows("assets", path.split(".")[0]) if r[0].lower() == path.lower()), None)

    # -- lineage over the store

    def marks(self) -> Marks:
        return Marks(self)

    def view_lineage(self, path: str) -> dict:
        row = self.store.one("results", function="lineage", subject=path)
        return json.loads(row["value"]) if row and row["value"] else {"columns": [], "scans": [], "joins": [], "conditions": [], "mapping": [], "complete": False}

    def _direct(self, path: str) -> list[str]:
        row = self.store.one("results", function="lineage", subject=path)
        return [e["from"] for e in self.store.current("edges", result=row["id"]) if e["kind"] == "reads"] if row else []

    def _is_view(self, path: str) -> bool:
        ds, name, column = split(path)
        return column is None and name is not None and name in self.views_of(ds)

    def _through(self, names: list[str]) -> list[str]:
        """The relations and, through views, all they read."""
        seen: list[str] = []
        todo = list(names)
        while todo:
            n = todo.pop(0)
            if n not in seen:
                seen.append(n)
                todo += self._direct(n) if self._is_view(n) else []
        return seen

    def edges(self, ds: str) -> list[tuple[str, str, str]]:
        """(from, to, kind): contains, relates, reads and computes, joins, loaded_from, and those of kits' kinds."""
        out = [(ds, f"{ds}.{t}", "contains") for t in self.relations(ds)]
        out += [(f"{ds}.{t}", f"{ds}.{t}.{c}", "contains") for t in self.relations(ds) for c in self.columns_of(ds, t)]
        for r in self.store.current("relationships", dataset=ds):
            path = f"{r['left_side']} {r['op']} {r['right_side']}"
            out += [(path, f"{'.'.join(split(s)[:2])}.{k}", "relates") for s in (r["left_side"], r["right_side"]) for k in parse_side(s)[2]]
        for row in self.store.current("results", dataset=ds, function="lineage"):
            out += [(e["from"], e["to"], e["kind"]) for e in self.store.current("edges", result=row["id"])]
            out += [(row["subject"], c, "joins") for j in self.view_lineage(row["subject"])["joins"] for c in (j["left"], j["right"])]
        out += [(r["source"], f"{ds}.{r['table_name']}", "loaded_from") for r in self.store.current("recipes", dataset=ds)]
        return sorted(set(out) | set(self.kind_rows("edges", ds)))

    def view_kind(self, ds: str, view: str) -> str | None:
        d = self.definition_of(ds, view)
        return d.get("kind") if d else None

    def definition_of(self, ds: str, view: str) -> dict | None:
        by = {g["actor_kind"]: g for g in self.store.current("glossary", subject=ds, property=view)}
        g = by.get("human") or by.get("agent")
        return json.loads(g["body"]) if g else None

    # -- places

    def place(self, subject: str, where: str) -> tuple[list[str], set[tuple[str, str]]]:
        """The assets of a place as seen from a subject, and the nodes that its walk passed."""
        own = [r for r in (self.kind_rows("places", split(sides(subject)[0] if is_pair(subject) else subject)[0])) if r[1] == where]
        if where not in PLACES and not own:
            raise LanguageError(f"{where!r} is no place", "not_a_place")
        ds, table, column = split(sides(subject)[0] if is_pair(subject) else subject)
        view = not is_pair(subject) and table and self._is_view(f"{ds}.{table}")
        relation = f"{ds}.{table}"
        walk: set[tuple[str, str]] = {(relation, "result lineage")} if view else set()
        reads = self._through(self._direct(relation)) if view else []
        loaded = [r for r in reads if not self._is_view(r)]
        if own:
            node = next(((r[1], r[2]) for r in self.kind_rows("assets", ds) if r[0] == subject), None)
            return sorted({r[2] for r in own if r[0] in (None, subject)}), {node} if node else set()
        if where == "itself":
            return [subject], set()
        if where == "its dataset":
            return [ds], set()
        if where == "its columns":
            if is_pair(subject) or column:
                return [], set()
            if table is None:
                return [f"{ds}.{t}" for t in self.relations(ds)], {(ds, "assets"), (ds, "relationships")}
            return [f"{relation}.{c}" for c in self.columns_of(ds, table)], walk or {(relation, "definition")}
        if where == "its sources":
            if not view:
                return [], set()
            value = self.view_lineage(relation)
            if column:
                return sorted({s for c in value["columns"] if c["column"] == column for s in c["sources"]}), walk
            return sorted({*self._direct(relation), *(s["table"] for s in value["scans"]), *(f"{s['table']}.{c}" for s in value["scans"] for c in s["columns"])}), walk
        if where == "the columns it joins on":
            return (sorted({c for j in self.view_lineage(relation)["joins"] for c in (j["left"], j["right"])}), walk) if view else ([], set())
        if where == "its relationships":
            every = {f"{r['left_side']} {r['op']} {r['right_side']}": {".".join(split(s)[:2]) for s in (r["left_side"], r["right_side"])} for r in self.store.current("relationships", dataset=ds)}
            if is_pair(subject):
                return [subject], {(ds, "relationships")}
            if table is None:
                return sorted(every), {(ds, "relationships")}
            if view:
                nodes = walk | {(r, "result lineage") for r in reads if self._is_view(r)} | {(r, "relationships") for r in [relation, *reads]}
                return sorted(p for p, ends in every.items() if relation in ends or ends <= {*reads}), nodes
            hit = [p for p, ends in every.items() if relation in ends]
            if column:
                hit = [p for p in hit if any(column in parse_side(s)[2] and ".".join(split(s)[:2]) == relation for s in (sides(p)[0], sides(p)[2]))]
            return sorted(hit), {(relation, "relationships")}
        if where == "its source systems":
            names = loaded if view else [relation] if table and not column else []
            found = {r["source"] for n in names for r in self.store.current("recipes", dataset=split(n)[0], table_name=split(n)[1])}
            return sorted(found), walk | {(n, "recipe") for n in names}
        if where in ("the dataset's metrics", "the dataset's single values"):
            kind = "metric" if where.endswith("metrics") else "value"
            views = [v for v in self.views_of(ds) if self.view_kind(ds, v) == kind]
            return [p for v in views for p in (f"{ds}.{v}", *(f"{ds}.{v}.{c}" for c in self.columns_of(ds, v)))], {(ds, f"views {kind}")} | {(f"{ds}.{v}", "definition") for v in views}
        assets = [ds, *(p for t in self.relations(ds) for p in (f"{ds}.{t}", *(f"{ds}.{t}.{c}" for c in self.columns_of(ds, t))))]
        assets += [f"{r['left_side']} {r['op']} {r['right_side']}" for r in self.store.current("relationships", dataset=ds)] + [r[0] for r in self.kind_rows("assets", ds)]
        return assets, {(ds, "assets"), (ds, "relationships")}

    # -- values and judgments

    def in_scope(self, subject: str, scope: str) -> bool:
        if subject == scope or subject.startswith(scope + "."):
            return True
        return is_pair(subject) and any(s == scope or s.startswith(scope + ".") or "." not in scope and s.split(".")[0] == scope for s in (sides(subject)[0], sides(subject)[2]))

    def values(self, ds: str | None, scope: str, prop: str | None = None) -> list[dict]:
        """Every value in scope: glosses and the results of functions, with who said it and its state."""
        marks, check = self.marks(), Check(self.store)
        out = []
        swept = {p["name"] for p in self.store.current("properties") if "SOURCE" in (p["grains"] or [])}
        sources = {r["name"] for r in self.store.current("sources")}
        for g in self.store.current("glossary"):
            wide = g["subject"] in sources and g["property"] in swept
            if prop not in (None, g["property"]) or not (wide and scope in (ds, g["subject"]) or g["dataset"] == ds and self.in_scope(g["subject"], scope)):
                continue
            out.append({"subject": g["subject"], "property": g["property"], "actor_kind": g["actor_kind"], "body": g["body"], "at": g["begin_snapshot"], "written_at": g["written_at"], "state": "stale" if marks.stale(g) else "current", "error": None})
        for r in self.store.current("results", dataset=ds):
            if r["property"] in ("test",) or prop not in (None, r["property"]) or not self.in_scope(r["subject"], scope):
                continue
            out.append({"subject": r["subject"], "property": r["property"], "actor_kind": "function", "body": r["value"], "at": r["begin_snapshot"], "written_at": r["computed_at"], "state": check.state(r), "error": r["error"], "function": r["function"]})
        return out

    def values_of(self, prop: str, ds: str, scope: str) -> dict[str, list[dict]]:
        """By subject, the values that a test of the property judges: failed computations are none."""
        held: dict[str, list[dict]] = {}
        for v in self.values(ds, scope, prop):
            if v["error"] is None and v["body"] is not None:
                held.setdefault(v["subject"], []).append(v)
        return held

    def judgments(self, ds: str, scope: str, prop: str | None = None) -> list[dict]:
        check = Check(self.store)
        tests = {t["name"]: t for t in self.store.current("tests")}
        out = []
        for r in self.store.current("results", dataset=ds):
            t = tests.get(r["function"])
            if r["property"] != "test" or t is None or prop not in (None, t["property"]) or not self.in_scope(r["subject"], scope):
                continue
            value = json.loads(r["value"]) if r["value"] else None
            if r["error"] is None and value is None:
                continue  # no judgment
            out.append({"subject": r["subject"], "property": t["property"], "test": t["name"], "state": "error" if r["error"] else value["state"], "score": 0.0 if r["error"] else value["score"], "computed_at": r["computed_at"], "current": check.state(r) == "current", "error": r["error"], "threshold": t["threshold"]})
        return sorted(out, key=lambda j: (j["subject"], j["property"], j["test"]))

    def _scope(self, text: str | None) -> tuple[str, str, str | None]:
        """dataset, scope path and property of a read's argument; none is the dataset in use."""
        if text is None or not text.strip():
            if self.used is None:
                raise LanguageError("no dataset is in use")
            return self.used, self.used, None
        if text.strip()[:1] in "'$":
            raise LanguageError("a subject is written as a path, not as a string", "quoted_subject")
        what, prop = subject_of(text)
        subject = self.resolver.resolve(what)
        return subject.dataset or self.used, subject.path, prop

    def glossary(self, subject: str | None = None, all: bool = False) -> DataFrame:  # noqa: A002
        """What is known in scope: the pick of each (subject, property) and its state, or with ``all`` every value."""
        ds, scope, prop = self._scope(subject)
        if prop and self.store.one("properties", name=prop) is None:
            raise LanguageError(f"{prop} is not declared")
        values, judged = self.values(ds, scope, prop), self.judgments(ds, scope, prop)
        if all:
            kinds = {p["name"]: p["kind"] for p in self.store.current("properties")}
            tests = {t["property"]: t["name"] for t in self.store.current("tests")}
            rows = [(v["subject"], v["property"], kinds.get(v["property"]), tests.get(v["property"]), v["actor_kind"], v["body"], v["written_at"], v["state"] == "current" if v["actor_kind"] == "function" else True, v["error"]) for v in values]
            return self.spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[1], RANK[r[4]])), "subject string, property string, kind string, test string, actor string, body string, written_at string, current boolean, error string")
        best: dict[tuple[str, str], dict] = {}
        for j in judged:
            key = j["subject"], j["property"]
            if key not in best or (j["state"] != "error", j["score"]) > (best[key]["state"] != "error", best[key]["score"]):
                best[key] = j
        groups: dict[tuple[str, str], list[dict]] = {}
        for v in values:
            if v["error"] is None and v["body"] is not None:
                groups.setdefault((v["subject"], v["property"]), []).append(v)
        rows = []
        for key, vs in groups.items():
            pick = min(vs, key=lambda v: (RANK[v["actor_kind"]], -v["at"]))
            j = best.get(key)
            contested = len({v["actor_kind"] for v in vs}) > 1 and j is not None and j["state"] != "error" and j["threshold"] is not None and j["score"] > j["threshold"]
            rows.append((*key, None if contested else pick["body"], j and j["state"], j and j["score"], "conflict" if contested else pick["state"]))
        rows += [(s, p, None, None, None, "missing") for s, p in self.missing(ds, scope, prop) if (s, p) not in groups]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "subject string, property string, value string, test_state string, score double, state string")

    def missing(self, ds: str, scope: str, prop: str | None) -> list[tuple[str, str]]:
        """(subject, property) that a test exists for, within the property's grain and condition."""
        tested = {t["property"] for t in self.store.current("tests")}
        columns = [(t, c) for t in self.relations(ds) for c in self.columns_of(ds, t)]
        subjects = {
            "DATASET": [ds], "TABLE": [f"{ds}.{t}" for t in self.relations(ds)], "COLUMN": [f"{ds}.{t}.{c}" for t, c in columns],
            "RELATIONSHIP": [f"{r['left_side']} {r['op']} {r['right_side']}" for r in self.store.current("relationships", dataset=ds)],
            "SOURCE": [r["name"] for r in self.store.current("sources")],
        }
        out = []
        for p in self.store.current("properties"):
            if p["name"] not in tested or prop not in (None, p["name"]) or p["kind"] == "VIEW":
                continue
            condition = json.loads(p["condition"]) if p["condition"] else None
            for grain in p["grains"] or ["DATASET", "TABLE", "COLUMN", "RELATIONSHIP"]:
                for s in subjects[grain]:
                    if not (scope in (ds, s) if grain == "SOURCE" else self.in_scope(s, scope)):
                        continue
                    if condition and "types" in condition:
                        kind = self.column_type(*split(s))
                        if kind is None or base_type(kind) not in {base_type(t) for t in condition["types"]}:
                            continue
                    elif condition:
                        said = [v for v in self.values_of(condition["property"], ds, s).get(s, [])]
                        if not said or json.loads(min(said, key=lambda v: (RANK[v["actor_kind"]], -v["at"]))["body"]).get("value") != condition["value"]:
                            continue
                    out.append((s, p["name"]))
        return out

    def tests(self, subject: str | None = None) -> DataFrame:
        ds, scope, prop = self._scope(subject)
        rows = [tuple(j[k] for k in ("subject", "property", "test", "state", "score", "computed_at", "current", "error")) for j in self.judgments(ds, scope, prop)]
        return self.spark.createDataFrame(rows, "subject string, property string, test string, state string, score double, computed_at string, current boolean, error string")

    def outdated(self) -> DataFrame:
        return self.spark.createDataFrame(Check(self.store).outdated(), "dataset string, function string, subject string, asset string, what string, reason string")

    # -- the read functions of bodies

    def read_annotations(self, subject: str, prop: str, where: str) -> DataFrame:
        assets, _ = self.place(subject, where)
        ds = split(sides(subject)[0] if is_pair(subject) else subject)[0]
        picked = {r.subject: r for r in self._picked(ds, prop)}
        rows = [(a, prop, (p := picked.get(a)) and p.value, p.test_state if p else None, p.score if p else None, p.state if p else "missing") for a in assets if self._admits(prop, a)]
        return self.spark.createDataFrame(rows, "asset string, property string, value string, test_state string, score double, state string")

    def _picked(self, ds: str, prop: str):
        used, self.used = self.used, ds
        try:
            return [r for r in self.glossary(f'"{ds}"::{prop}').collect() if r.state != "missing"] if self.store.one("properties", name=prop) else []
        finally:
            self.used = used

    def _admits(self, prop: str, asset: str) -> bool:
        p = self.store.one("properties", name=prop)
        return p is None or not p["grains"] or grain_of(asset, {r["name"] for r in self.store.current("sources")}) in p["grains"]

    def read_results(self, subject: str, function: str, where: str) -> DataFrame:
        assets, _ = self.place(subject, where)
        check = Check(self.store)
        rows = []
        for a in assets:
            r = self.store.one("results", function=function, subject=a)
            if r:
                past = sorted({(h["changed_at"], h["value"]) for h in self.store.history("results", function=function, subject=a)}, key=lambda h: h[0])
                rows.append((a, function, r["value"], check.state(r), r["error"], [(v, at) for at, v in past]))
        return self.spark.createDataFrame(rows, "asset string, function string, value string, state string, error string, history array<struct<value:string,changed_at:bigint>>")

    def read_definition(self, subject: str, where: str) -> DataFrame:
        rows = []
        for a in self.place(subject, where)[0]:
            ds, view, column = split(a)
            if is_pair(a) or column or view is None:
                continue
            d = self.definition_of(ds, view)
            if d is None:
                continue
            value = self.view_lineage(a)
            loaded = [(t, r["source"]) for t in self._through(self._direct(a)) if not self._is_view(t) for r in self.store.current("recipes", dataset=split(t)[0], table_name=split(t)[1])]
            rows.append((a, d.get("kind"), d.get("sql"), d.get("stopped"), self._direct(a), loaded, json.dumps(value["joins"]), json.dumps(value["conditions"])))
        return self.spark.createDataFrame(rows, "view string, kind string, sql string, stopped string, reads array<string>, loaded array<struct<table:string,source:string>>, joins string, conditions string")

    def definitions(self, ds: str) -> DataFrame:
        return self.read_definition(ds, "the dataset")

    # -- static checks of bodies

    def body_reads(self, script: str, scope: str, detector: bool) -> list:
        """What a body reads, from its text; a read that can't be told is refused."""
        reads, text, shift = [], _bound(script, "x.y.z", 0.5), 0
        for i, (name, args, start, end) in enumerate(self._calls(text)):
            text = text[: start - shift] + f"__call_{i}" + text[end - shift :]
            shift += end - start - len(f"__call_{i}")
            if name in READ_FUNCTIONS:
                wanted = 1 if name == "definition" else 2
                if len(args) != wanted or not all(isinstance(a, str) for a in args) or any(isinstance(a, Token) for a in args):
                    raise LanguageError(f"{name}: what it reads is not a constant", "untracked_read")
                if args[-1] not in PLACES and not any(r[1] == args[-1] for ds in self.datasets() for r in self.kind_rows("places", ds)):
                    raise LanguageError(f"{name}: {args[-1]!r} is no place", "untracked_read")
                reads.append([name, *args])
            elif name in ("glossary", "tests", "outdated"):
                raise LanguageError(f"{name} is read past the read functions", "untracked_read")
            else:
                reads.append(["primitive", name, *[a for a in args if isinstance(a, str)]])
        for r in relations_of(self.spark, text):
            if r[0].startswith("__call_") or detector and r == ("annotations",):
                continue
            if r[0] == "main" or len(r) == 1 and r[0].removesuffix("_history") in RELATIONS:
                raise LanguageError(f"{'.'.join(r)} is read past the read functions", "untracked_read")
            if len(r) > 2:
                raise LanguageError(f"{'.'.join(r)} is in another catalog", "untracked_read")
            reads.append(["data", ".".join(r) if len(r) == 2 or scope == "GLOBAL" else f"{scope}.{r[0]}"])
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
        for f in re.findall(r"UnresolvedTableValuedFunction \[([^\]]+)\]", plan):
            if f.lower() not in FREE:
                raise LanguageError(f"{f}: what it reads can't be told", "untracked_read")
        return reads

    def cross_subject(self, script: str) -> None:
        """Refuses a detector that compares the subjects it runs over."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(_bound(script, "x", 0.5)).toString()
        refuse = lambda why: LanguageError(why, "cross_subject")
        for line in plan.split("\n"):
            for spec in re.findall(r"windowspecdefinition\(([^)]*)", line):
                parts = [x for x in spec.split(", ") if " ASC" not in x and " DESC" not in x and "frame" not in x]
                if not any(re.fullmatch(r"'(?:\w+\.)?subject", x) for x in parts):
                    raise refuse("a window isn't partitioned by subject")
            if (m := re.search(r"'Aggregate \[(.*?)\], \[", line)) and not re.search(r"'(?:\w+\.)?subject\b", m[1]):
                raise refuse("an aggregate isn't grouped by subject")
            if "'Project [" in line and re.search(_AGGREGATE, line) and "windowspec" not in line:
                raise refuse("an aggregate isn't grouped by subject")
            if re.search(r"'Join ", line) and plan.count("[annotations]") > 1 and "subject" not in line:
                raise refuse("values are joined without their subject")

    def nodes_read(self, f: dict, subject: Subject) -> set[tuple[str, str]]:
        """The nodes that a function reads for a subject."""
        s = subject.path
        ds = subject.dataset
        nodes = {(f["name"], "function"), (f["returns"], "property")}
        for what, *args in json.loads(f["reads"]):
            if what == "annotations":
                assets, walk = self.place(s, args[1])
                nodes |= walk | {(args[0], "property")} | {(t["detector"], "function") for t in self.store.current("tests", property=args[0]) if t["detector"]}
                for a in assets:
                    if self._admits(args[0], a):
                        nodes |= {(a, f"annotation {args[0]}"), (a, f"value {args[0]}"), (".".join(split(a)[:2]) if not is_pair(a) and "." in a else a, "definition")}
            elif what == "results":
                assets, walk = self.place(s, args[1])
                nodes |= walk | {(a, f"result {args[0]}") for a in assets}
            elif what == "definition":
                assets, walk = self.place(s, args[0])
                nodes |= walk | {n for a in assets if self._is_view(a) for n in ((a, "definition"), (a, "result lineage"), *((t, "recipe") for t in self._through([a]) if not self._is_view(t)))}
            elif what == "data":
                nodes |= self._data_nodes([args[0] if "." in args[0] else f"{ds}.{args[0]}"])
            else:
                nodes |= self._primitive_nodes(args[0], s, args[1:])
        return nodes

    def _data_nodes(self, names: list[str]) -> set[tuple[str, str]]:
        out = set()
        for n in self._through(names):
            out |= {(n, "definition"), (n, "result lineage")} if self._is_view(n) else {(n, "data"), (n, "definition")}
        return out

    def _primitive_nodes(self, name: str, subject: str, args: list[str]) -> set[tuple[str, str]]:
        if is_pair(subject):
            left, _, right = sides(subject)
            return self._data_nodes([".".join(split(left)[:2]), ".".join(split(right)[:2])]) | {(split(left)[0], "relationships")}
        ds, table, _ = split(subject)
        if name in ("additivity_cells", "additivity_anchors"):
            tables = [f"{ds}.{t}" for t in self.tables_of(ds)]
            return self._data_nodes([f"{ds}.{table}", *tables]) | {(ds, "relationships")} | {(f"{t}.{c}", "annotation role") for t in tables for c in self.columns_of(ds, split(t)[1])}
        if name == "series_aggregate" and len(args) > 1:
            assets, walk = self.place(subject, args[1])
            return walk | self._data_nodes([a for a in assets if a.count(".") == 1])
        if name == "definition_collisions":
            return self._data_nodes([f"{ds}.{v}" for v in self.views_of(ds)]) | {(ds, "assets")}
        if table:
            return self._data_nodes([f"{ds}.{table}"])
        return self._data_nodes([f"{ds}.{t}" for t in self.tables_of(ds)]) | {(ds, "assets"), (ds, "relationships")}

    # -- table functions in queries and bodies

    def body(self, f: dict, subject: Subject) -> DataFrame:
        with self._in(subject.dataset or self.used):
            return self.spark.sql(self.expand(_bound(f["script"], subject.path, None), subject.path))

    def detect(self, f: dict, values: list[dict], threshold: float | None) -> DataFrame:
        rows = [(v["subject"], v["property"], v["actor_kind"], v["body"], v["state"] == "current") for v in values]
        view = self._viewed(self.spark.createDataFrame(rows, "subject string, property string, actor_kind string, body string, current boolean"))
        text = _bound(f["script"], "", threshold)
        toks = tokens(text)
        for i in range(len(toks) - 1, -1, -1):
            t = toks[i]
            if t.kind == "name" and t.value == "annotations" and i and toks[i - 1].text.upper() in ("FROM", "JOIN", ",") and not (i + 1 < len(toks) and toks[i + 1].text in "(."):
                text = text[: t.start] + f"{view} AS annotations" + text[t.end :]
        return self.spark.sql(text)

    def _viewed(self, df: DataFrame) -> str:
        name = f"_read_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _table_functions(self) -> set[str]:
        return {"subject_column", "dataset_cells", "dataset_columns", "series_aggregate", "hierarchy_candidates", "relationship_candidates", "relationship_checks", "derivation_candidates", "definition_collisions", "additivity_cells", "additivity_anchors", "column_profile_of", "outlier_profile_of", "temporal_profile_of", "geometry_profile_of", "lineage_of", "lineage_edges", "views_lineage", "views_scans", "views_joins", "views_mapping", "tables_read", "place_list", "place", "definitions", "kind_assets", "kind_edges", "kind_places", "glossary", "tests", "outdated", *READ_FUNCTIONS} | {f["name"] for f in self.store.current("functions") if f["returns"]}

    def _calls(self, text: str) -> list[tuple[str, list, int, int]]:
        """(name, arguments, start, end) of the table functions called where a relation stands."""
        toks, known, out = tokens(text), self._table_functions(), []
        for i, t in enumerate(toks):
            if not (t.kind == "name" and t.value in known and i + 1 < len(toks) and toks[i + 1].text == "(" and i and toks[i - 1].text.upper() in ("FROM", "JOIN", ",")):
                continue
            depth, j = 0, i + 1
            while True:
                depth += {"(": 1, ")": -1}.get(toks[j].text, 0) if toks[j].kind == "op" else 0
                if depth == 0:
                    break
                j += 1
            inner = toks[i + 2 : j]
            if t.value in ("glossary", "tests"):
                args: list = [text[inner[0].start : inner[-1].end] if inner else ""]
            else:
                args, one = [], []
                for x in [*inner, None]:
                    if x is None or x.kind == "op" and x.text == "," :
                        if one:
                            args.append(self._argument(one))
                        one = []
                    else:
                        one.append(x)
            out.append((t.value, args, t.start, toks[j].end))
        return out

    @staticmethod
    def _argument(toks: list[Token]):
        if len(toks) == 1:
            t = toks[0]
            if t.kind in ("string", "dollar"):
                return t.value
            if t.kind == "number":
                return float(t.text) if "." in t.text else int(t.text)
            if t.value in ("true", "false"):
                return t.value == "true"
        if len(toks) == 3 and toks[1].text == "=>":
            return {toks[0].value: Reads._argument(toks[2:])}
        return toks[0]  # not a constant

    def expand(self, text: str, subject: str | None = None) -> str:
        """The text with store relations, versions of tables and table functions as views of this session."""
        for name, args, start, end in reversed(self._calls(text)):
            text = text[:start] + self._viewed(self._call_table(name, args, subject)) + text[end:]
        text = re.sub(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s+AT\s*\(\s*VERSION\s*=>\s*(\d+)\s*\)", lambda m: self._viewed(self.table(m[1], m[2], int(m[3]))), text, flags=re.I)

        def stored(m: re.Match) -> str:
            name, past = (m[1][:-8], True) if m[1].lower().endswith("_history") else (m[1], False)
            return self._viewed(self.store.frame(self.spark, name.lower(), past)) if name.lower() in RELATIONS else m[0]

        return re.sub(r"\bmain\.([A-Za-z_]\w*)", stored, text)

    def _tables(self, path: str) -> dict[str, DataFrame]:
        ds, table, _ = split(path)
        return {t: self.relation(ds, t) for t in ([table] if table else self.tables_of(ds))}

    def _call_table(self, name: str, args: list, subject: str | None) -> DataFrame:
        spark = self.spark
        if name == "glossary":
            text, wide = re.subn(r"(^|,)\s*all\s*=>\s*true\s*$", "", args[0], flags=re.I)
            return self.glossary(text or None, bool(wide))
        if name == "tests":
            return self.tests(args[0] or None)
        if name == "outdated":
            return self.outdated()
        if name in READ_FUNCTIONS:
            where = subject or self.used
            return {"annotations": self.read_annotations, "results": self.read_results, "definition": self.read_definition}[name](where, *args)
        if name == "lineage_of":
            with self._in(self.used):
                found = plan_lineage(spark.sql(self.expand(args[0])))
            return spark.createDataFrame([(c["column"], c["derivation"], c["sources"], c["shape"]) for c in found.columns], "column string, derivation string, sources array<string>, shape string")
        options = {k: v for a in args if isinstance(a, dict) for k, v in a.items()}
        args = [a for a in args if not isinstance(a, dict)]
        if not args or not isinstance(args[0], str):
            raise LanguageError(f"{name} takes a subject")
        path = self._path_text(args[0])
        ds, table, column = (None, None, None) if is_pair(path) else split(path)
        if name == "place":
            return spark.createDataFrame([(a,) for a in self.place(path, args[1])[0]], "asset string")
        if name == "definitions":
            return self.definitions(path)
        if name == "place_list":
            return spark.createDataFrame([(p,) for p in PLACES] + sorted({(r[1],) for r in self.kind_rows("places", ds)}), "`where` string")
        if name == "tables_read":
            return spark.createDataFrame([(t,) for t in self._through(self._direct(f"{ds}.{table}")) if not self._is_view(t)], "asset string")
        if name.startswith("views_"):
            return self._views(ds, table, name[6:])
        if name == "lineage_edges":
            return spark.createDataFrame(self.edges(ds), "`from` string, `to` string, kind string")
        if name.startswith("kind_"):
            schema = {"assets": "asset string, node_asset string, node_what string, kind string", "edges": "`from` string, `to` string, kind string", "places": "subject string, `where` string, asset string"}[name[5:]]
            return spark.createDataFrame(self.kind_rows(name[5:], path), schema)
        if name == "subject_column":
            return cells.subject_column(self.relation(ds, table), column)
        if name in ("column_profile_of", "outlier_profile_of", "temporal_profile_of", "geometry_profile_of"):
            df = self.relation(ds, table)
            if name == "column_profile_of":
                # one pass over the table serves all its columns in a statement
                got = self._once(("column_profile", ds, table), lambda: profiles.column_profile(df).collect())
                return spark.createDataFrame([r for r in got if column in (None, r["column"])], "column string, total bigint, null_ratio double, distinct bigint, min string, max string")
            return {"outlier_profile_of": profiles.outlier_profile, "temporal_profile_of": profiles.temporal_profile, "geometry_profile_of": geometry.geometry_profile}[name](df, column)
        if name == "dataset_columns":
            views = {v: self.relation(ds, v) for v in self.views_of(ds) if self.columns_of(ds, v)} if len(args) > 1 and args[1] else {}
            return cells.columns(spark, self._tables(path), views)
        if name == "dataset_cells":
            tables = self._tables(path)
            if len(args) > 1:
                views = {v: self.relation(ds, v) for v in self.views_of(ds) if self.columns_of(ds, v)}
                if args[1] is True:
                    tables |= views
                elif args[1] == "views":
                    tables = views
                elif isinstance(args[1], str):
                    wanted = {a for a in self.place(path, args[1])[0] if a.count(".") == 1}
                    tables = {split(a)[1]: self.relation(*split(a)[:2]) for a in wanted}
            return cells.dataset_cells(spark, tables, options.get("cells"))
        if name == "hierarchy_candidates":
            return hierarchy.hierarchy_candidates(self.relation(ds, table))
        if name == "derivation_candidates":
            return derivation.derivation_candidates(self.relation(ds, table))
        if name == "relationship_candidates":
            return relationships.relationship_candidates(spark, self._tables(path)).withColumn("from_col", F.concat(F.lit(f"{ds}."), "from_col")).withColumn("to_col", F.concat(F.lit(f"{ds}."), "to_col"))
        if name == "relationship_checks":
            return self._relationship_checks(path)
        if name == "definition_collisions":
            return self._collisions(ds)
        if name in ("additivity_cells", "additivity_anchors"):
            got = additivity_axes.additivity_cells(self, ds, table, column)
            return got if name == "additivity_cells" else additivity.additivity_anchors(got)
        if name == "series_aggregate":
            return self._series(path, *args[1:])
        f = self.function(name, ds)
        return self.body(f, Subject(path, grain_of(path), ds or split(sides(path)[0])[0], table, column))

    def _views(self, ds: str, view: str | None, what: str) -> DataFrame:
        """Of the stored lineage of a dataset's views (or one), a row per column, scan, join or mapped column."""
        told = [(f"{ds}.{v}", self.view_lineage(f"{ds}.{v}")) for v in self.views_of(ds) if view in (None, v)]
        schema, row = {
            "lineage": ("view string, column string, derivation string, shape string, complete boolean", lambda v, x: [(v, c["column"], c["derivation"], c["shape"], x["complete"]) for c in x["columns"]]),
            "scans": ("view string, table string, columns array<string>", lambda v, x: [(v, s["table"], s["columns"]) for s in x["scans"]]),
            "joins": ("view string, join int, left string, right string, left_unique boolean, right_unique boolean", lambda v, x: [(v, *(j[k] for k in ("join", "left", "right", "left_unique", "right_unique"))) for j in x["joins"]]),
            "mapping": ("view string, column string, branch int, source string, derivation string", lambda v, x: [(v, *(m[k] for k in ("column", "branch", "source", "derivation"))) for m in x["mapping"]]),
        }[what]
        return self.spark.createDataFrame([r for v, x in told for r in row(v, x)], schema)

    def _once(self, key: tuple, make):
        held = getattr(self, "_shared", None)
        if held is None:
            return make()
        if key not in held:
            held[key] = make()
        return held[key]

    def _path_text(self, text: str) -> str:
        if is_pair(text):
            what, _ = subject_of(text)
            return self.resolver.pair(what).path
        if self.used is None or text.split(".")[0] in self.datasets():
            return text
        what, _ = subject_of(text)
        return self.resolver.resolve(what).path

    def _relationship_checks(self, path: str) -> DataFrame:
        paths = [path] if is_pair(path) else self.place(path, "its relationships")[0]
        out = None
        for seq, p in enumerate(paths, 1):
            left, op, right = sides(p)
            (lds, lt, lk), (rds, rt, rk) = parse_side(left), parse_side(right)
            part = relationships.relationship_check(self.relation(lds, lt), lk, self.relation(rds, rt), rk, p, seq, (lds, lt) == (rds, rt))
            out = part if out is None else out.unionByName(part)
        return relationships.relationship_checks(self.spark, {}, []) if out is None else out

    def claims(self, ds: str, prop: str) -> dict[str, dict]:
        """Winning values of a property by subject."""
        return {s: json.loads(min(vs, key=lambda v: (RANK[v["actor_kind"]], -v["at"]))["body"]) for s, vs in self.values_of(prop, ds, ds).items()}

    def _collisions(self, ds: str) -> DataFrame:
        roles, adds = self.claims(ds, "role"), self.claims(ds, "additivity")
        found, views = [], {}
        for v in sorted({g["property"] for g in self.store.current("glossary", subject=ds)}):
            d = self.definition_of(ds, v)
            if not d or "sql" not in d or v not in self.views_of(ds):
                continue
            one: dict = {"property": v, "subject": ds, "flavor": d.get("kind"), "sql": d["sql"]}
            for key, role in (("period", "timestamp"), ("value", "measure")):
                named = sorted(split(s)[2] for s, r in roles.items() if s.startswith(f"{ds}.{v}.") and r.get("value") == role)
                one[key] = named[0] if len(named) == 1 else key if key in named else None
            if claim := adds.get(f"{ds}.{v}.{one['value'] or 'value'}"):
                one |= {"additivity": claim.get("value"), "num": claim.get("numerator"), "den": claim.get("denominator")}
            found.append(one)
            views[v] = self.relation(ds, v)
        return series.definition_collisions(self.spark, found, views)

    def _series(self, path: str, where: str, axes: str, grain: str) -> DataFrame:
        """``axes`` names a query of (view, period, value, at_grain, by_instant, num, den, dimensions), a view of the dataset."""
        views = [a for a in self.place(path, where)[0] if a.count(".") == 1]
        rows = [r.asDict() for r in self.relation(split(path)[0], axes).collect()]
        told = [series.Axes(r["view"], r["period"], r["value"], r.get("at_grain") or grain, bool(r.get("by_instant")), r.get("num"), r.get("den"), tuple(r.get("dimensions") or ())) for r in rows]
        return series.series_aggregate(self.spark, {split(v)[1]: self.relation(*split(v)[:2]) for v in views}, told)


def _bound(script: str, subject: str | None, threshold: float | None) -> str:
    """$subject as a string and $threshold as a number, as whole words."""
    text = script if subject is None else re.sub(r"\$subject\b", lambda _: "'" + subject.replace("'", "''") + "'", script)
    return re.sub(r"\$threshold\b", "CAST(NULL AS DOUBLE)" if threshold is None else repr(float(threshold)), text)
