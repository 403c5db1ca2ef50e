"""A model service: POST of a JSON body to a route, the answer as JSON."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import pandas as pd

TIMEOUT = 600


def call(base: str, route: str, body: str, token: str | None = None, soft: bool = False, timeout: float = TIMEOUT) -> str | None:
    """The answer; a failure raises, or is told as {"error": ...} if soft."""
    if body is None:
        return None
    request = urllib.request.Request(f"{base.rstrip('/')}/{route.lstrip('/')}", data=body.encode(), method="POST", headers={"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            text = answer.read().decode()
        json.loads(text)
        return text
    except (urllib.error.URLError, OSError, ValueError) as e:
        if soft:
            return json.dumps({"error": str(e)})
        raise RuntimeError(f"{route}: {e}") from e


def register(spark) -> None:
    """service(route, body) and service_soft(route, body) for SQL; address and token are settings of the session."""
    from pyspark.sql import functions as F

    base, token = spark.conf.get("ledgerlens.service.url", ""), spark.conf.get("ledgerlens.service.token", None)
    timeout = float(spark.conf.get("ledgerlens.service.timeout", str(TIMEOUT)))

    def made(soft: bool):
        def each(route: pd.Series, body: pd.Series) -> pd.Series:
            return pd.Series([call(base, r, b, token, soft, timeout) for r, b in zip(route, body)], dtype=object)

        return F.pandas_udf(each, "string").asNondeterministic()

    spark.udf.register("service", made(False))
    spark.udf.register("service_soft", made(True))
