"""When each node of the catalog last changed, and which stored results that makes out of date.

Pure functions over the store's rows: nodes are (asset, what), a result reads nodes, and a node changed at the latest
snapshot at which one of its rows begins or ends.
"""

from __future__ import annotations

import json
from collections import defaultdict

from .store import Store
from .subjects import parse_side, split


def _g(row: dict) -> int:
    return max(row["begin_snapshot"], row["end_snapshot"] or 0)


def view_properties(store: Store) -> set[str]:
    return {r["name"] for r in store.history("properties") if r["kind"] == "VIEW"}


def changes(store: Store) -> list[tuple]:
    """(key, what, dataset, function, at, checked, marked): checked where results are, marked where annotations are."""
    out: list[tuple] = []

    def add(key: str, what: str, at: int | None, checked: bool = True, marked: bool = False, dataset=None, function=None) -> None:
        if at is not None:
            out.append((key.lower(), what, dataset, function, at, checked, marked))

    for t in store.history("tables"):
        name = f"{t['dataset']}.{t['table_name']}"
        add(name, "data", _g(t))
    created: dict[str, list[int]] = defaultdict(list)
    for c in store.history("columns"):
        name = f"{c['dataset']}.{c['table_name']}"
        add(f"{name}.{c['column_name']}", "definition", _g(c), marked=True)
        add(name, "definition", c["end_snapshot"], checked=False, marked=True)
        add(name, "definition", _g(c))
        add(c["dataset"], "assets", _g(c))
        created[name].append(c["begin_snapshot"])
    for v in store.history("views"):
        name = f"{v['dataset']}.{v['view_name']}"
        add(name, "definition", _g(v), marked=True)
        add(f"vcol:{name}", "definition", _g(v), marked=True)
        add(v["dataset"], "assets", _g(v))
    loads: dict[str, list[dict]] = defaultdict(list)
    for i in sorted(store.history("imports"), key=lambda r: r["begin_snapshot"]):
        loads[f"{i['dataset']}.{i['table_name']}"].append(i)
    for name, rows in loads.items():
        for before, now in zip([None, *rows], rows):
            add(name, "data", now["snapshot_id"])
            if before is None:
                continue
            a, b = json.loads(before["lineage"] or "{}"), json.loads(now["lineage"] or "{}")
            if a != b:
                add(name, "definition", now["snapshot_id"])
            if any(b.get(k) != d for k, d in a.items()):
                add(name, "definition", now["snapshot_id"], checked=False, marked=True)
            for k, d in a.items():
                if b.get(k) != d:
                    add(f"{name}.{k}", "definition", now["snapshot_id"], marked=True)
    views = view_properties(store)
    defined = set()
    for g in store.history("glossary"):
        add(g["subject"], f"annotation {g['property']}", _g(g))
        if "." not in g["subject"] and g["property"] in views:
            add(f"{g['subject']}.{g['property']}", "definition", _g(g), marked=True)
            defined.add((f"{g['subject']}.{g['property']}", g["property"]))
            if kind := json.loads(g["body"]).get("kind"):
                add(g["subject"], f"views {kind}", _g(g))
    for p in store.history("properties"):
        add(p["name"], "property", _g(p))
        for name, prop in defined:
            if prop.lower() == p["name"].lower():
                add(name, "definition", _g(p), marked=True)
    for t in store.history("tests"):
        add(t["property"], "property", _g(t))
        add(t["name"], "function", _g(t))
    for f in store.history("functions"):
        add(f["name"], "function", _g(f))
    for r in store.history("recipes"):
        add(f"{r['dataset']}.{r['table_name']}", "recipe", _g(r))
    for r in store.history("relationships"):
        for s in (r["left_side"], r["right_side"]):
            ds, table, _ = parse_side(s)
            add(f"{ds}.{table}", "relationships", _g(r))
        add(r["dataset"], "relationships", _g(r))
    results: dict[tuple, list[dict]] = defaultdict(list)
    for r in store.history("results"):
        results[r["subject"], r["dataset"], r["function"], r["property"]].append(r)
    for (subject, dataset, function, prop), rows in results.items():
        live = [r["changed_at"] for r in rows if r["end_snapshot"] is None]
        at = max(live) if live else max(r["end_snapshot"] for r in rows)
        add(subject, f"result {function}", at, dataset=dataset, function=function)
        add(subject, f"value {prop}", at, dataset=dataset, function=function)
    return out


def _definition_keys(asset: str) -> list[str]:
    ds, table, column = split(asset.lower())
    return [asset.lower(), f"vcol:{ds}.{table}"] if column else [asset.lower()]


class Check:
    """Which current results are out of date: ``changed`` by what, ``out`` in all, ``reads`` from result to result."""

    def __init__(self, store: Store):
        self.store = store
        now = {r["id"]: r for r in store.current("results")}
        by: dict[tuple, list[tuple]] = defaultdict(list)
        for key, what, dataset, function, at, checked, _ in changes(store):
            if checked:
                by[key, what].append((at, dataset, function))
        self.changed: dict[int, set[tuple[str, str]]] = defaultdict(set)
        self.reads: list[tuple[int, int, str, str]] = []
        expired = {r["asset"].lower() for r in store.current("expired")}
        holders: dict[tuple, list[dict]] = defaultdict(list)
        for r in now.values():
            for what in (f"result {r['function']}", f"value {r['property']}"):
                holders[r["dataset"], r["subject"].lower(), what].append(r)
        for i in store.current("inputs"):
            r = now.get(i["result"])
            if r is None:
                continue
            asset, what = i["asset"], i["what"]
            if what in ("definition", "data") and asset.lower() in expired and not by[asset.lower(), what]:
                self.changed[r["id"]].add((asset, what))  # none of its rows are left
            for key in _definition_keys(asset) if what == "definition" else [asset.lower()]:
                for at, dataset, function in by[key, what]:
                    if at > r["read_at"] and dataset in (None, r["dataset"]) and (function is None or function != r["function"]):
                        self.changed[r["id"]].add((asset, what))
            for read in holders[r["dataset"], asset.lower(), what]:
                if what.startswith("result ") or read["function"] != r["function"]:
                    self.reads.append((r["id"], read["id"], asset, what))
        readers: dict[int, set[int]] = defaultdict(set)
        for reader, read, _, _ in self.reads:
            readers[read].add(reader)
        self.out = set(self.changed)
        todo = list(self.out)
        while todo:
            for reader in readers[todo.pop()]:
                if reader not in self.out:
                    self.out.add(reader)
                    todo.append(reader)

    def state(self, result: dict) -> str:
        """current, stale or possibly."""
        return "stale" if result["id"] in self.changed else "possibly" if result["id"] in self.out else "current"

    def outdated(self) -> list[tuple]:
        now = {r["id"]: r for r in self.store.current("results")}
        rows = {(now[i]["dataset"], now[i]["function"], now[i]["subject"], a, w, "changed") for i, nodes in self.changed.items() for a, w in nodes}
        rows |= {(now[i]["dataset"], now[i]["function"], now[i]["subject"], a, w, "possibly") for i, read, a, w in self.reads if read in self.out}
        return sorted(rows)


class Marks:
    """Whether an annotation is stale: the definition of its subject changed after it was written, or is gone."""

    def __init__(self, ws):
        self.ws = ws
        self.at: dict[str, int] = defaultdict(int)
        for key, what, _, _, at, _, marked in changes(ws.store):
            if marked and what == "definition":
                self.at[key] = max(self.at[key], at)

    def stale(self, gloss: dict) -> bool:
        subject = gloss["subject"]
        if " -> " in subject or " <-> " in subject or "." not in subject:
            return False
        ds, table, column = split(subject)
        if table not in self.ws.relations(ds):
            return self.ws.kind_asset(subject) is None
        if column is not None and column not in self.ws.columns_of(ds, table):
            return True
        is_view = table in self.ws.views_of(ds)
        keys = [f"vcol:{ds}.{table}".lower()] if column and is_view else [subject.lower()]
        return any(self.at.get(k, 0) > gloss["begin_snapshot"] for k in keys)
