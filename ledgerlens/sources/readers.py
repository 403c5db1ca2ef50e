"""Declared sources: files under a root directory, or a relational database."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READ = re.compile(r"\bread_(parquet|csv|json|json_auto|csv_auto|orc)\s*\(\s*'([^']*)'((?:\s*,\s*[A-Za-z_]\w*\s*=>?\s*(?:'[^']*'|[\w.]+))*)\s*\)", re.I)
_OPTION = re.compile(r"([A-Za-z_]\w*)\s*=>?\s*('[^']*'|[\w.]+)")
#: Options of readers, under the names that recipes use.
_NAMES = {"delim": "sep", "nullstr": "nullValue", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "header": "header", "quote": "quote", "escape": "escape"}
CORRUPT = "_corrupt_record"


class Source:
    """Runs a recipe's SQL where the source is; ``dropped`` counts the rows that a reader could not read."""

    def __init__(self, spark: SparkSession, settings: dict, options: dict | None = None):
        self.spark, self.settings, self.options = spark, settings, options or {}
        self.rejects: list[DataFrame] | None = []

    def run(self, sql: str) -> DataFrame:
        if self.settings.get("type") == "relational_db":
            return self._relational(sql)
        return self.spark.sql(_READ.sub(self._view, sql))

    def dropped(self) -> int | None:
        """Rows kept out by store_rejects; null where errors were ignored, 0 where they'd have failed."""
        if self.rejects is None:
            return None
        return sum(r.count() for r in self.rejects)

    def _view(self, m: re.Match) -> str:
        kind, path = m[1].lower().removesuffix("_auto"), m[2]
        options = {k.lower(): v.strip("'") for k, v in _OPTION.findall(m[3] or "")}
        root = self.settings.get("location", "").rstrip("/")
        full = path if not root or path.startswith("/") or "://" in path else f"{root}/{path}"
        reader = self.spark.read
        ignore, store = options.pop("ignore_errors", "false") == "true", options.pop("store_rejects", "false") == "true"
        if kind == "csv":
            reader = reader.option("header", options.pop("header", "true")).option("inferSchema", "true")
        for k, v in options.items():
            reader = reader.option(_NAMES.get(k, k), v)
        if kind in ("csv", "json") and (ignore or store):
            df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            schema = reader.format(kind).load(full).schema
            if CORRUPT not in schema.fieldNames():
                schema = schema.add(CORRUPT, "string")
            df = df.schema(schema).format(kind).load(full).cache()
            if store and self.rejects is not None:
                self.rejects.append(df.filter(F.col(CORRUPT).isNotNull()))
            if ignore and not store:
                self.rejects = None
            df = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
        else:
            df = (reader.option("mode", "FAILFAST") if kind in ("csv", "json") else reader).format(kind).load(full)
        name = f"_source_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _relational(self, sql: str) -> DataFrame:
        """The statement runs at the database, in its own dialect."""
        reader = self.spark.read.format("jdbc").option("url", self.settings["location"]).option("query", sql.strip().rstrip(";"))
        for k, v in self.options.items():  # what ``via`` names, held by the engine
            reader = reader.option(k, v)
        return reader.load()
