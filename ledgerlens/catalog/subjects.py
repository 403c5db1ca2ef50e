"""Subjects: what a gloss, a result or a test attaches to, and how a path resolves to one."""

from __future__ import annotations

from dataclasses import dataclass

from .language import LanguageError, Pair, Path


@dataclass(frozen=True)
class Subject:
    """A resolved subject; ``path`` is its name in the store."""

    path: str
    grain: str
    dataset: str | None = None
    table: str | None = None
    column: str | None = None


def split(path: str) -> tuple[str, str | None, str | None]:
    """dataset, table, column: the column is all that follows the second dot."""
    parts = path.split(".", 2)
    return parts[0], parts[1] if len(parts) > 1 else None, parts[2] if len(parts) > 2 else None


def side_text(dataset: str, table: str, keys: tuple[str, ...]) -> str:
    return f"{dataset}.{table}.{keys[0] if len(keys) == 1 else '(' + ', '.join(keys) + ')'}"


def parse_side(text: str) -> tuple[str, str, list[str]]:
    ds, table, key = split(text)
    return ds, table, [k.strip() for k in key[1:-1].split(",")] if key.startswith("(") else [key]


def match(name: str, names) -> str | None:
    """The catalog's spelling of a name, whatever its case."""
    return next((n for n in names if n == name), None) or next((n for n in names if n.lower() == name.lower()), None)


class Resolver:
    """Resolves against a workspace: its datasets, relations, sources and the dataset in use."""

    def __init__(self, ws):
        self.ws = ws

    def table(self, parts: tuple[str, ...]) -> tuple[str, str]:
        """dataset and relation of [dataset.]table."""
        if len(parts) == 2:
            ds = match(parts[0], self.ws.datasets())
            if ds is None:
                raise LanguageError(f"no dataset {parts[0]}")
            return ds, parts[1]
        if self.ws.used is None:
            raise LanguageError(f"{parts[0]}: no dataset is in use")
        return self.ws.used, parts[0]

    def side(self, side: tuple[tuple[str, ...], tuple[str, ...]], must_exist: bool) -> str:
        ds, table = self.table(side[0])
        columns = self.ws.columns_of(ds, table)
        if must_exist and not columns:
            raise LanguageError(f"no table {ds}.{table}")
        keys = []
        for k in side[1]:
            found = match(k, columns)
            if found is None and must_exist:
                raise LanguageError(f"no column {k} in {ds}.{table}")
            keys.append(found or k)
        return side_text(ds, match(table, self.ws.relations(ds)) or table, tuple(keys))

    def pair(self, pair: Pair, must_exist: bool = True) -> Subject:
        left, right = self.side(pair.left, must_exist), self.side(pair.right, must_exist)
        return Subject(f"{left} {pair.op} {right}", "RELATIONSHIP", left.split(".")[0])

    def resolve(self, what: Path | Pair, sources: bool = False) -> Subject:
        if isinstance(what, Pair):
            return self.pair(what)
        parts, ws = what.parts, self.ws
        if len(parts) == 1:
            if (ds := match(parts[0], ws.datasets())) is not None:
                return Subject(ds, "DATASET", ds)
            if ws.used and (t := match(parts[0], ws.relations(ws.used))) is not None:
                return Subject(f"{ws.used}.{t}", "TABLE", ws.used, t)
            if (s := match(parts[0], [r["name"] for r in ws.store.current("sources")])) is not None:
                return Subject(s, "SOURCE")
            if ws.used and (k := ws.kind_asset(f"{ws.used}.{parts[0]}")):
                return Subject(f"{ws.used}.{parts[0]}", k.upper(), ws.used)
            raise LanguageError(f"{parts[0]} is no dataset, table or source")
        if len(parts) == 2:
            used = match(parts[0], ws.relations(ws.used)) if ws.used else None
            if used is not None:  # the dataset in use is the nearer scope
                return self._column(ws.used, used, parts[1])
            if (ds := match(parts[0], ws.datasets())) is None:
                raise LanguageError(f"{parts[0]} is no dataset, nor a table of the dataset in use")
            t = match(parts[1], ws.relations(ds))
            if t is None and (k := ws.kind_asset(f"{ds}.{parts[1]}")):
                return Subject(f"{ds}.{parts[1]}", k.upper(), ds)
            return Subject(f"{ds}.{t or parts[1]}", "TABLE", ds, t or parts[1])
        if (ds := match(parts[0], ws.datasets())) is None:
            raise LanguageError(f"no dataset {parts[0]}")
        return self._column(ds, match(parts[1], ws.relations(ds)) or parts[1], parts[2])

    def _column(self, ds: str, table: str, column: str) -> Subject:
        name = match(column, self.ws.columns_of(ds, table)) or column
        return Subject(f"{ds}.{table}.{name}", "COLUMN", ds, table, name)
